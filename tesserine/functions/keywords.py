"""Summaries and keywords of chunks: cleaning, checks and the texts used where no model answers. Column in, Column out, JVM only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserine.functions.text import strip

#: Verbs that make a keyword useless.
VERBS = (
    "get", "set", "wrap", "load", "return", "handle", "create", "make", "build", "process", "execute", "run", "call", "invoke", "perform", "do", "use",
    "implement", "provide", "generate", "parse", "validate", "check", "verify", "update", "modify", "change", "transform", "convert", "format", "encode",
    "decode", "serialize", "deserialize", "marshal", "unmarshal", "send", "receive", "fetch", "retrieve", "store", "save", "delete", "remove",
    "add", "insert", "append", "prepend", "merge", "split", "join", "connect", "disconnect", "open", "close", "start", "stop", "begin", "end", "init",
    "initialize", "cleanup", "destroy", "release", "acquire", "lock", "unlock",
)
#: Words that say nothing.
FILLERS = ("code", "chunk", "logic", "method", "function", "implementation", "routine", "procedure", "block", "section", "part", "piece", "system", "module", "component", "unit", "element", "item", "thing", "stuff", "data", "information", "value", "result")
#: Phrases of a question about everything.
BROAD = ("systems", "architecture", "overview", "design", "explain", "describe", "what do you know", "tell me about")
#: Parts of keywords that are paths.
PATHS = ("/", "\\", "github.com", "golang.org", "google.golang.org")
#: Summary and keywords of generated files by the end of their path.
GENERATED = (
    (".pb.go", "Gegenereerde protobuf-berichten en hulpfuncties; geen domeinlogica.", ("protobuf", "gegenereerd", "berichten", "hulpmethoden", "grpc")),
    (".gen.go", "Gegenereerde Go-code; geen handmatige wijzigingen.", ("gegenereerd", "go", "code", "automatisch", "tool")),
    ("", "Gegenereerde code; geen domeinlogica.", ("gegenereerd", "code", "automatisch", "tool", "geen-logica")),
)


def _distinct(items: Column) -> Column:
    return F.array_distinct(items)  # keeps the first of equal items in place


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: F.length(w) > 0)


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def normalized_summary(text: Column, most: int = 160) -> Column:
    """The first sentence without closing quotes and brackets; cut at a blank after 100 characters if it is too long. Null counts as empty."""
    first = strip(F.get(F.split(F.coalesce(text, F.lit("")), "[.!?]+"), F.lit(0)))
    first = strip(F.regexp_replace(first, r'[")]+$', ""))
    head = F.substring(first, 1, most)
    blank = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (blank > 100), F.substring(head, F.lit(1), blank)).otherwise(head)
    return F.when(F.length(first) > most, cut).otherwise(first)


def linted(keywords: Column, most: int = 10) -> Column:
    """Lower case, blanks for underscores, the last four words, ASCII only; short ones and paths dropped, distinct."""
    tail = lambda k: F.when(F.size(words(k)) > 4, F.array_join(F.slice(words(k), -4, 4), " ")).otherwise(k)
    tidy = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: ascii_only(tail(F.replace(strip(F.lower(F.coalesce(k, F.lit("")))), F.lit("_"), F.lit(" ")))))
    is_path = lambda k: F.exists(F.array(*[F.lit(p) for p in PATHS]), lambda p: F.contains(k, p))
    return F.slice(_distinct(F.filter(tidy, lambda k: (F.length(k) >= 2) & ~is_path(k))), 1, most)


def linted_nouns(keywords: Column, most: int = 8) -> Column:
    """Sorted distinct keywords of two to four words without identifiers, digits, verbs and fillers."""

    def tidy(k: Column) -> Column:
        k = F.regexp_replace(strip(F.lower(F.coalesce(k, F.lit("")))), r"\.[\p{L}\p{N}_]+$", "")
        return strip(F.regexp_replace(F.regexp_replace(k, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))

    good = lambda k: ~k.rlike(r"[_\p{N}]") & F.size(words(k)).between(2, 4) & ~F.exists(words(k), lambda w: w.isin(*VERBS, *FILLERS))
    return F.slice(F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), tidy), good))), 1, most)


def english_summary(summary: Column, least: float = 0.85) -> Column:
    """Without its other characters where less than ``least`` of it is ASCII."""
    return F.when(F.length(ascii_only(summary)) < F.length(summary) * least, ascii_only(summary)).otherwise(summary)


def english_keywords(keywords: Column) -> Column:
    return F.filter(keywords, lambda k: ~k.rlike(r"[^\x00-\x7F]"))


def fallback_summary(kind: Column, name: Column, receiver: Column, identifiers: Column) -> Column:
    """A sentence made of the declaration and its first two capitalised identifiers."""
    nouns = F.transform(F.slice(F.filter(identifiers, lambda x: x.rlike(r"^\p{Lu}\p{L}{2,}$")), 1, 2), F.lower)
    about = F.concat(F.lit(" — "), F.when(F.size(nouns) > 0, F.array_join(nouns, " and ")).otherwise(F.lit("code")), F.lit("."))
    raw = strip(F.coalesce(receiver, F.lit("")))
    pointed, last = strip(F.get(F.split(raw, r"\*"), F.lit(1))), F.element_at(words(F.concat(F.lit("x "), raw)), -1)
    of_type = F.when(F.contains(raw, F.lit("*")), pointed).when(F.size(words(raw)) > 1, last).otherwise(F.lit(""))
    named = lambda default: F.coalesce(F.nullif(name, F.lit("")), F.lit(default))
    what = (
        F.when(kind == "method", F.concat(F.lit("Method "), F.when(of_type != "", F.concat(of_type, F.lit("."))).otherwise(F.lit("")), named("method")))
        .when(kind == "function", F.concat(F.lit("Function "), named("function")))
        .when(kind == "type", F.concat(F.lit("Type "), named("type")))
        .when(kind == "header", F.lit("Package/import header"))
        .otherwise(F.lit("Code chunk"))
    )
    return F.concat(what, about)


def generated_summary(path: Column) -> Column:
    """(summary, keywords) of a generated file."""
    out = None
    for end, summary, keywords in GENERATED:
        value = F.struct(F.lit(summary).alias("summary"), F.array(*[F.lit(k) for k in keywords]).alias("keywords"))
        if not end:
            return out.otherwise(value)
        hit = F.endswith(F.lower(path), F.lit(end))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def is_broad(question: Column) -> Column:
    return F.exists(F.array(*[F.lit(b) for b in BROAD]), lambda b: F.contains(F.lower(question), b))


def has_spotlight(answer: Column) -> Column:
    return F.contains(answer, F.lit("Spotlight")) | F.contains(answer, F.lit("spotlight"))
