"""Per-repository and per-file summaries: counters, excerpts, important files, neighbours, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import ordered
from tesserine.plans.staging import staged


def top_values(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """(group, value, n, place): the k most frequent values of each group, ties by value. Counts are combined before the shuffle."""
    counted = df.groupBy(group, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), value)
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def excerpts(chunks: DataFrame, file: str, order: list[str], size: Column, most: int) -> DataFrame:
    """Chunks of each file, in order, up to and including the one that passes the limit. Sizes are never negative; null counts as 0."""
    return ordered.running(chunks, [file], order, {"__before": size}, {"__before": most}).drop("__before")


def budgeted(blocks: DataFrame, group: str, order: list[str], size: Column, most: int) -> DataFrame:
    """The blocks of each group, in order, that a budget holds; blocks before the first one with a size don't count as held."""
    return ordered.running(blocks, [group], order, {"__total": size}, {"__total": most}, through=True).where("__total IS NOT NULL").drop("__total")


def neighbours(chunks: DataFrame, file: str, key: str, order: list[str]) -> DataFrame:
    """prev_id and next_id of each chunk within its file; ties of the order by key."""
    return ordered.beside(chunks, [file], order, key, "prev_id", "next_id")


def unpivoted_counts(df: DataFrame, **flags: Column) -> DataFrame:
    """(issue, n) of every flag that is true for a row or more, from one scan."""
    one = df.agg(*[F.count_if(c).alias(k) for k, c in flags.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("issue"), F.col(k).alias("n")) for k in flags])
    return one.select(F.inline(pairs)).where("n > 0")


def quality_issues(chunks: DataFrame) -> DataFrame:
    """(issue, n) of the seven chunk quality checks that count a chunk or more, from one scan.

    chunks: n_tokens, text, summary_en, keywords_en (array); nulls count as 0 or empty. A
    missing summary counts only where any chunk has one.
    """
    tokens, text = F.coalesce("n_tokens", F.lit(0)), T.strip(F.coalesce("text", F.lit("")))
    has_summary, words = F.coalesce(F.length("summary_en"), F.lit(0)) > 0, F.coalesce(F.size("keywords_en"), F.lit(0))
    flags = {
        "tiny": tokens < 10, "huge": tokens > 1000, "empty": text == "", "incomplete": (text != "") & ~F.right(text, F.lit(1)).isin("}", ")", ";", '"'),
        "missing_summary": ~has_summary, "short_summary": has_summary & (F.length("summary_en") < 20), "few_keywords": (words > 0) & (words < 3),
    }
    one = chunks.agg(F.count_if(has_summary).alias("with_summary"), *[F.count_if(c).alias(k) for k, c in flags.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("issue"), F.col(k).alias("n")) for k in flags])
    return one.select("with_summary", F.inline(pairs)).where("n > 0 AND (issue <> 'missing_summary' OR with_summary > 0)").select("issue", "n")


#: Languages that a code fence names.
FENCED = ("go", "python", "typescript", "javascript", "java", "c", "cpp", "rust", "ruby", "php")


def evidence(chunks: DataFrame, group: str, order: list[str], max_items: int = 12, max_code_chars: int = 10000) -> DataFrame:
    """(group, evidence): the numbered evidence block of each group's first chunks; longer code is trimmed and marked.

    chunks: repo_id, rel_path, start_line, end_line, primary_symbol, primary_kind, all_roles (array), summary_en, language, text; nulls count as empty.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    items = chunks.withColumn("item", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("item") <= max_items)
    roles = F.when(F.size("all_roles") > 0, F.array_join("all_roles", ",")).otherwise(F.lit("n/a"))
    header = F.concat(F.lit("["), plain("item"), F.lit("] "), plain("repo_id"), F.lit(" | "), plain("rel_path"), F.lit(" | L"), plain("start_line"), F.lit("–"), plain("end_line"), F.lit(" | "), plain("primary_symbol"), F.lit(" ("), plain("primary_kind"), F.lit("/"), roles, F.lit(")"))
    summary = F.when(F.length("summary_en") > 0, F.concat(F.lit("summary: "), T.strip(F.replace("summary_en", F.lit("\n"), F.lit(" ")))))
    code = T.strip(plain("text"))
    code = F.when(F.length(code) > max_code_chars, F.concat(F.substring(code, 1, max_code_chars), F.lit("\n// … trimmed due to size …"))).otherwise(code)
    fence = F.concat(F.lit("```"), F.when(F.lower("language").isin(*FENCED), F.lower("language")).otherwise(F.lit("")))
    item = F.concat_ws("\n", header, summary, F.lit("code:"), fence, code, F.lit("```"), F.lit(""))
    blocks = items.select(group, "item", item.alias("block")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("item", "block"))).alias("x"))
    return blocks.select(group, F.concat(F.lit("EVIDENCE\n--------\n"), F.array_join(F.transform("x", lambda s: s["block"]), "\n")).alias("evidence"))


#: Lines of a bucket of the interval join.
LINES = 64


def best_overlap(left: DataFrame, right: DataFrame, file: str, key: str) -> DataFrame:
    """For each left range the right range of the same file with the largest overlap, ties to the first.

    left: file, key, start_line, end_line; right: file, r_key, r_start, r_end.

    Equal ranges of a file are compared once, and only ranges that meet in a bucket of
    ``LINES`` lines are paired, so a file's pairs are bounded by its distinct ranges near each other.
    """
    buckets = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / LINES), F.floor(F.greatest(a, b) / LINES))).alias("bucket")
    spans = left.select(file, "start_line", "end_line").distinct()
    others = right.groupBy(file, "r_start", "r_end").agg(F.min("r_key").alias("r_key"))
    joined = spans.select("*", buckets("start_line", "end_line")).join(others.select("*", buckets("r_start", "r_end")), [file, "bucket"]).where("r_start <= end_line AND r_end >= start_line")
    overlap = F.least("end_line", "r_end") - F.greatest("start_line", "r_start") + 1
    best = F.max(F.struct(overlap.alias("overlap"), (-F.col("r_key")).alias("minus")))
    found = joined.groupBy(file, "start_line", "end_line").agg(best.alias("b"))
    return left.join(found, [file, "start_line", "end_line"]).groupBy(file, key).agg(F.max("b").alias("b")).select(file, key, (-F.col("b.minus")).alias("r_key"), F.col("b.overlap").alias("overlap"))


#: A method's signature, from the start of its line.
METHOD = r"(?m)^func\s*\(([^)]*)\)\s*([A-Za-z_][A-Za-z0-9_]*)\s*\("


def enclosing_signature(chunks: DataFrame, file: str, order: list[str], back: int = 2) -> DataFrame:
    """The chunks with the signature, receiver and name of the first method among the ``back`` chunks before each; null without one.

    Chunks are numbered in parts, and what is found is sent on to the numbers that see it, so a file of any size is spread over tasks.
    """
    part = lambda group: F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), METHOD, group), F.lit(""))
    found = F.when(part(2).isNotNull(), F.struct(part(0).alias("signature"), F.trim(F.coalesce(part(1), F.lit(""))).alias("receiver"), part(2).alias("method")))
    rows = staged(ordered.numbered(chunks.drop("enclosing"), [file], order, "__at"), "numbered")
    seen = rows.select(file, "__at", found.alias("found")).where("found IS NOT NULL").withColumn("sees", F.explode(F.sequence(F.col("__at") + 1, F.col("__at") + back)))
    nearest = seen.groupBy(file, F.col("sees").alias("__at")).agg(F.min_by("found", F.col("__at")).alias("enclosing"))
    return ordered.with_few(rows, nearest, [file, "__at"]).drop("__at")


def owner(spans: DataFrame, declarations: DataFrame, file: str, key: str) -> DataFrame:
    """(file, key, owner): the smallest declaration that contains each span, ties to the first; spans without one are left out.

    spans: file, key, start, end. declarations: file, decl, d_start, d_end. Both are met by
    buckets of ``LINES`` places of the span's start, so a file's pairs are bounded by the
    declarations over one bucket.
    """
    bucket = F.floor(F.col("start") / LINES)
    over = declarations.select("*", F.explode(F.sequence(F.floor(F.col("d_start") / LINES), F.floor(F.col("d_end") / LINES))).alias("bucket"))
    met = spans.withColumn("bucket", bucket).join(over, [file, "bucket"]).where("d_start <= start AND end <= d_end")
    best = F.min(F.struct((F.col("d_end") - F.col("d_start")).alias("size"), "d_start", "decl"))
    return met.groupBy(file, key).agg(best.alias("b")).select(file, key, F.col("b.decl").alias("owner"))
