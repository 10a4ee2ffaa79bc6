"""Reports on chunks: filtered lists, an HTML page, and differences of two texts. The driver gets the few rows shown."""

from __future__ import annotations

import difflib
import html

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions.numbers import rounded
from tesserine.functions.text import strip

MOST = 100


def chosen(chunks: DataFrame, path: str | None = None, least_tokens: int | None = None, most_tokens: int | None = None, kind: str | None = None, no_summary: bool = False, sample: int | None = None, seed: int = 7) -> DataFrame:
    """The chunks that pass all conditions given; ``sample`` draws that many of them, the same for the same seed."""
    if path is not None:
        chunks = chunks.where(F.contains("rel_path", F.lit(path)))
    if least_tokens is not None:
        chunks = chunks.where(F.col("n_tokens") >= least_tokens)
    if most_tokens is not None:
        chunks = chunks.where(F.col("n_tokens") <= most_tokens)
    if kind is not None:
        chunks = chunks.where(F.col("node_kind") == kind)
    if no_summary:
        chunks = chunks.where(F.length(strip(F.coalesce("summary_en", F.lit("")))) == 0)
    return chunks if sample is None else chunks.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)


#: Upper bounds of the buckets of tokens, the name of each, and that of the last.
BUCKETS = ((50, "under_50"), (100, "50_100"), (200, "100_200"), (300, "200_300"))
OVER = "over_300"
#: Forms of a path that are counted, the first that holds.
FORMS = (("go:file_header", "file_headers"), ("interface", "interfaces"), ("struct", "structs"), ("function", "functions"), ("method", "methods"))


def profile(chunks: DataFrame) -> DataFrame:
    """(dimension, value, chunks, tokens, mean, least, most, median, p90) of chunks by language, path, form of path, bucket of tokens, import, symbol, flag, and all.

    chunks: language, ast_path, n_tokens, imports_used, symbols_referenced, prev, next,
    summary_1l, qa_terms. One scan serves all dimensions; median and p90 are exact, from the counts of
    each number of tokens, which are one row a value and number. Null tokens count as 0, a null language as
    unknown, a null path as empty. Imports and symbols count once a chunk and mention. An empty table has no rows.
    """
    n = F.coalesce("n_tokens", F.lit(0))
    path = F.coalesce("ast_path", F.lit(""))
    bucket = F.coalesce(*[F.when(n < most, F.lit(name)) for most, name in BUCKETS], F.lit(OVER))
    form = F.coalesce(*[F.when(path == word if i == 0 else F.contains(path, F.lit(word)), F.lit(name)) for i, (word, name) in enumerate(FORMS)])
    some = lambda c: F.coalesce(F.length(F.col(c)) > 0, F.lit(False))
    held = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    flags = {"imports": held("imports_used"), "symbols": held("symbols_referenced"), "neighbor": F.col("prev").isNotNull() | F.col("next").isNotNull(), "summary": some("summary_1l"), "qa_terms": some("qa_terms")}
    pair = lambda dimension, value: F.struct(F.lit(dimension).alias("dimension"), value.alias("value"))
    single = [pair("all", F.lit("")), pair("language", F.coalesce("language", F.lit("unknown"))), pair("path", path), pair("bucket", bucket), pair("form", form), *[pair("with", F.when(has, F.lit(name))) for name, has in flags.items()]]
    each = lambda dimension, c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: pair(dimension, v))
    many = [each("import", "imports_used"), each("symbol", "symbols_referenced")]
    rows = chunks.select(n.cast("long").alias("n"), F.explode(F.filter(F.concat(F.array(*single), *many), lambda x: x["value"].isNotNull())).alias("x")).select("n", "x.*")
    counted = rows.groupBy("dimension", "value", "n").agg(F.count("*").alias("c"))
    group = Window.partitionBy("dimension", "value")
    counted = counted.withColumn("upto", F.sum("c").over(group.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("c").over(group))
    at = lambda tenths: F.min(F.when(F.col("upto") * 10 >= F.col("all") * tenths, F.col("n")))
    tokens = F.sum(F.col("n") * F.col("c"))
    return counted.groupBy("dimension", "value").agg(F.sum("c").alias("chunks"), tokens.alias("tokens"), rounded(tokens / F.sum("c"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), at(5).alias("median"), at(9).alias("p90"))


def summary(chunks: DataFrame) -> DataFrame:
    """One row: chunks, files, mean, least and greatest number of tokens, and the share with a summary."""
    has = F.length(strip(F.coalesce("summary_en", F.lit("")))) > 0
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct("rel_path").alias("files"), F.round(F.avg("n_tokens"), 2).alias("mean_tokens"), F.min("n_tokens").alias("least_tokens"), F.max("n_tokens").alias("most_tokens"), F.round(F.try_divide(F.count_if(has), F.count("*")), 6).alias("with_summary"))


def html_report(chunks: DataFrame, title: str = "Chunks", most: int = MOST) -> str:
    """A page with the summary of all chunks and the first ``most`` of them by file and line."""
    total = summary(chunks).first().asDict()
    shown = chunks.orderBy("rel_path", "start_line", "id").limit(most).collect()
    numbers = "".join(f"<li>{html.escape(k)}: {html.escape(str(v))}</li>" for k, v in total.items())
    items = "".join(
        f"<section><h2>{html.escape(f'{r.rel_path}:{r.start_line}-{r.end_line}')}</h2><p>{html.escape(r.summary_en or 'no summary')}</p><p>{html.escape(f'{r.n_tokens} tokens, {r.node_kind}')}</p><pre>{html.escape(r.text or '')}</pre></section>"
        for r in shown
    )
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><ul>{numbers}</ul><p>{len(shown)} shown</p>{items}</body></html>"


def difference(before: str, after: str, name: str = "text", context: int = 3) -> str:
    """The unified difference of two texts; empty if they are equal."""
    return "\n".join(difflib.unified_diff(before.splitlines(), after.splitlines(), f"{name} (before)", f"{name} (after)", n=context, lineterm=""))
