"""The engine in SQL text: chunkers as table functions, expressions as SQL functions, indexes and logs as views."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from tesserine.functions import chunkers, lexer
from tesserine.operators import ann, postings
from tesserine.streaming.upsert import UpsertLog


@udtf
class CodeChunks:
    """``code_chunks(text, ext [, limit])``: chunk_number, start_line, end_line, text.

    Without a limit the text is cut at every declaration; with one, neighbouring declarations are
    merged up to that many tokens and larger ones split. Null text gives no rows.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, ext: AnalyzeArgument, limit: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType) or not isinstance(ext.dataType, StringType):
            raise ValueError("code_chunks takes a text and an extension as strings")
        if limit is not None and (not limit.isConstantExpression or limit.value is not None and limit.value < 1):
            raise ValueError("the limit of code_chunks must be a positive constant")
        schema = StructType()
        for name in ("chunk_number", "start_line", "end_line"):
            schema = schema.add(name, IntegerType())
        return AnalyzeResult(schema.add("text", StringType()))

    def eval(self, text: str | None, ext: str | None, limit: int | None = None) -> Iterator[tuple[int, int, int, str]]:
        if text is not None:
            yield from chunkers.packed_chunks(text, ext or "", limit) if limit else chunkers.chunk_lines(text, ext or "")


@udtf(returnType="kind string, name string, receiver string, type_name string, type_kind string, start_line int, end_line int, start_byte int, end_byte int")
class GoDeclarations:
    """``go_declarations(text)``: functions, methods and types of a Go file. Null text gives no rows."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        for d in chunkers.go_declarations(text or ""):
            yield tuple(d[c] for c in ("kind", "name", "receiver_text", "type_name", "type_kind", "start_line", "end_line", "start_byte", "end_byte"))


#: SQL functions over columns: name, parameters, result, body.
FUNCTIONS = (
    ("tokens", "t STRING", "ARRAY<STRING>", "filter(split(lower(t), '[^a-z0-9_]+'), x -> length(x) > 0)"),
    ("inner_product", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    ("lines_of", "t STRING, first INT, last INT", "STRING", "array_join(slice(split(t, '\\n', -1), first, greatest(last - first + 1, 0)), '\\n')"),
    ("go_package", "t STRING", "STRING", "regexp_extract(t, '(?m)^\\\\s*package\\\\s+(\\\\w+)', 1)"),
    ("rank_share", "r INT, k INT", "DOUBLE", "1D / (k + r)"),
)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; their names."""
    spark.udtf.register("code_chunks", CodeChunks)
    spark.udtf.register("go_declarations", GoDeclarations)
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return ["code_chunks", "go_declarations", *[f[0] for f in FUNCTIONS]]


def view(source: postings.Index | ann.VectorIndex | UpsertLog, name: str) -> None:
    """Stored data as temporary views: an index of postings as name_postings and name_terms, a vector index as name_lists, a log as name."""
    if isinstance(source, postings.Index):
        source.postings.createOrReplaceTempView(f"{name}_postings")
        source.spark.read.parquet(f"{source.path}/terms").createOrReplaceTempView(f"{name}_terms")
    elif isinstance(source, ann.VectorIndex):
        source.lists.createOrReplaceTempView(f"{name}_lists")
    else:
        source.read().createOrReplaceTempView(name)


#: Extensions that code_chunks cuts by declarations.
EXTENSIONS = tuple(sorted(lexer.LANGUAGES))
