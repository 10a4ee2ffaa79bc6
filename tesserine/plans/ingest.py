"""From source files to chunk rows, and from changed files to the rows that must be made again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.functions import chunkers, go
from tesserine.functions import text as T
from tesserine.sources.chunks import file_order


def build_chunks(files: DataFrame, repo_id: str, generated_boost: float = 0.35) -> DataFrame:
    """One row per chunk of (rel_path, ext, text) files.

    Everything but the cut happens in the row of the file or of its chunk. Only the neighbours
    need an exchange, by file. For Go, package, imports and the first declaration that begins in
    the chunk are filled in; other languages leave them empty.
    """
    is_go = F.col("ext") == "go"
    named = files.select(
        F.lit(repo_id).alias("repo_id"), "rel_path", "ext", T.is_generated(F.col("rel_path"), F.col("text")).alias("is_generated"),
        F.when(is_go, chunkers.go_package(F.col("text"))).alias("package"), F.when(is_go, chunkers.go_imports(F.col("text"))).alias("imports"),
        F.when(is_go, chunkers.go_structure(F.col("text"))).alias("declarations"), chunkers.code_chunks(F.col("text"), F.col("ext")).alias("chunks"),
    )
    rows = named.select(*[c for c in named.columns if c != "chunks"], F.inline("chunks"))
    inside = F.filter("declarations", lambda d: d["start_line"].between(F.col("start_line"), F.col("end_line")))
    rows = rows.withColumn("inside", inside).drop("declarations", "chunk_number")
    out = rows.select(
        F.substring(F.sha2(F.concat_ws("\n", "repo_id", "rel_path", F.col("start_line").cast("string"), "text").cast("binary"), 256), 1, 16).alias("id"),
        "repo_id", "rel_path", F.col("ext").alias("language"), "start_line", "end_line", "text", "is_generated",
        F.when(F.col("is_generated"), F.lit(generated_boost)).otherwise(F.lit(1.0)).alias("rank_boost"), F.size(T.tokens(F.col("text"))).alias("n_tokens"),
        "package", "imports", F.get("inside", F.lit(0))["name"].alias("primary_symbol"), F.get("inside", F.lit(0))["kind"].alias("primary_kind"),
        F.coalesce(F.transform("inside", lambda d: d["name"]), F.array().cast("array<string>")).alias("def_symbols"),
    )
    return file_order(out)


def go_chunks(files: DataFrame, repo_id: str, limit: int = 1000) -> DataFrame:
    """One row a chunk of (rel_path, text) Go files: the header, then each declaration, or its logical parts where it holds more than ``limit`` tokens.

    The cut and the walk over the declarations happen in a worker; imports, symbols, the minimal header
    that every part repeats, paths and ids are expressions on the chunk's row, which knows the lines
    of its neighbours, so nothing is shuffled. Repeated rows are files like others;
    their ids are equal. Null text has no chunks.
    """
    text = F.col("text")
    read = files.select("rel_path", F.sha1(F.coalesce(text, F.lit("")).cast("binary")).alias("file_sha"), chunkers.go_package(text).alias("package"), chunkers.go_imports(text).alias("imports"), chunkers.go_aliases(text).alias("aliases"), chunkers.go_code_chunks(text, limit).alias("chunks"))
    rows = read.select(*[c for c in read.columns if c != "chunks"], F.posexplode("chunks").alias("at", "c")).select("*", "c.*").drop("c")
    id_of = lambda which, at: F.concat(F.lit(f"{repo_id}/"), F.col("rel_path"), F.lit("#"), F.col(f"{which}start_line").cast("string"), F.lit("-"), F.col(f"{which}end_line").cast("string"), F.lit("#"), at.cast("string"))
    header, part = F.col("kind") == "header", F.col("part") > 0
    used = F.when(header, F.col("imports")).otherwise(go.used_imports(F.col("text"), F.coalesce("aliases", F.create_map().cast("map<string,string>"))))
    node = F.when(header, "package_declaration").otherwise(F.concat("kind", F.lit("_declaration")))
    receiver = F.concat(F.when(F.contains("receiver", F.lit("*")), F.lit("*")).otherwise(F.lit("")), F.coalesce("type_name", F.lit("")))
    path = go.syntax_path(node, F.col("name"), receiver, F.col("type_name"), F.coalesce("type_kind", F.lit("")))
    rows = rows.withColumn("strict", go.strict_symbols(F.col("text"), F.coalesce("aliases", F.create_map().cast("map<string,string>"))))
    rows = rows.withColumn("packages", go.qualifying(F.col("strict")))
    symbols = go.without_own(F.col("strict"), F.col("packages"), F.coalesce("name", F.lit("")))
    label = F.when(F.col("tokens").isNotNull(), F.coalesce("label", F.concat(F.lit("block"), F.col("part").cast("string")))).otherwise(go.block_label(F.col("text"), F.col("part") - 1))
    rows = rows.withColumn("imports_used", used).withColumn("ast_path", F.when(part, F.concat(path, F.lit("#part"), F.col("part").cast("string"), F.lit("_"), label)).otherwise(path))
    rows = rows.withColumn("header_context", go.header_context(F.col("package"), F.col("imports_used"), F.col("kind"), F.coalesce("receiver", F.lit(""))))
    rows = rows.withColumn("symbols_referenced", F.when(header, F.array().cast("array<string>")).otherwise(symbols)).withColumn("symbols_defined", F.when(header, F.array().cast("array<string>")).otherwise(F.array("name")))
    n_tokens = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))
    return rows.select(
        F.lit(repo_id).alias("repo_id"), "rel_path", "file_sha", id_of("", F.col("at")).alias("chunk_id"), id_of("before_", F.col("at") - 1).alias("prev"), id_of("after_", F.col("at") + 1).alias("next"), F.col("at").alias("chunk_number"), F.when(header, "header").otherwise(F.col("kind")).alias("node_kind"), "name", "receiver", "type_name", "type_kind",
        "start_line", "end_line", "part", "parts", "ast_path", "header_context", "imports_used", "symbols_defined", "symbols_referenced", F.coalesce("tokens", n_tokens(F.col("text"))).alias("n_tokens"), n_tokens(F.col("header_context")).alias("header_tokens"), "text",
    )


def blocks(files: DataFrame, lines: int = 50) -> DataFrame:
    """Fixed blocks of lines of each file, cut within the row."""
    rows = files.select("rel_path", T.lines(F.coalesce("text", F.lit(""))).alias("l"))
    rows = rows.select("rel_path", "l", F.explode(F.expr(f"sequence(0L, (size(l) - 1) div {lines})")).alias("block"))
    first = (F.col("block") * lines).cast("int")
    return rows.select("rel_path", (first + 1).alias("start_line"), F.least(first + lines, F.size("l")).alias("end_line"), F.array_join(F.slice("l", first + 1, F.lit(lines)), "\n").alias("text"))


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose path and content hash aren't in the manifest (rel_path, sha)."""
    hashed = files.withColumn("sha", F.sha1(F.coalesce("text", F.lit("")).cast("binary")))
    return hashed.join(manifest.select("rel_path", "sha"), ["rel_path", "sha"], "left_anti")


def refreshed(old: DataFrame, new: DataFrame, current: DataFrame) -> DataFrame:
    """The chunk table after an incremental run: new chunks, and old ones of files that still exist and weren't made again."""
    made = new.select("repo_id", "rel_path").distinct()
    kept = old.join(made, ["repo_id", "rel_path"], "left_anti").join(current.select("rel_path").distinct(), "rel_path", "left_semi")
    return new.unionByName(kept.select(*new.columns))
