"""Queries of the expressions on source text, names, keywords and plans, with their SQL.

No table holds source text, so orders are written as Go, Python, TypeScript and plain text by
one expression that both engines read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.functions import go, keywords, names
from tesserine.operators import planner
from tesserine.queries.registry import query, table

_S = "CAST({} AS STRING)".format
_GO = f"""concat('package pkg', {_S('o_custkey % 5')}, chr(10), 'import "time"', chr(10), '// json.Hidden note', chr(10), 'type Order', {_S('o_orderkey % 9')}, ' struct {{', chr(10), 'func (s *Order', {_S('o_orderkey % 9')}, ') Handle', o_orderstatus,
  '(x int) error {{', chr(10), '  /* zap.Gone */ s := "time.Quoted" + `raw.Text`', chr(10), '  return ', lower(substr(o_orderpriority, 3, 4)), '.Do', {_S('o_orderkey % 4')}, '(time.Now(), URL, Clerk', {_S('o_custkey % 3')}, ', json.Marshal)', chr(10), '}}', chr(10),
  'func helper', {_S('o_custkey % 6')}, '() {{ log.Print(cache.Get(*ptr)) }}')"""
_PY = f"""concat('\"\"\"Doc of ', o_orderpriority, '\"\"\"', chr(10), 'import os', chr(10), 'from x import y', chr(10), 'class Order', {_S('o_orderkey % 7')}, '(Base):', chr(10), '    def run_', lower(o_orderstatus), '(self):', chr(10), '        raise ValueError("status 404")', chr(10), chr(10))"""
_TS = f"""concat('import a from "b"', chr(10), 'const lib = require("x")', chr(10), 'export class View', {_S('o_orderkey % 7')}, ' {{}}', chr(10), 'export async function load', o_orderstatus, '(q) {{ return react }}', chr(10), 'const pick = async (v) => {{ return v }}')"""
#: Extension and text of an order's source.
EXT = "CASE o_orderkey % 4 WHEN 0 THEN 'go' WHEN 1 THEN 'py' WHEN 2 THEN 'ts' ELSE 'txt' END"
CODE = f"CASE o_orderkey % 4 WHEN 0 THEN {_GO} WHEN 1 THEN {_PY} WHEN 2 THEN {_TS} ELSE concat('Get status 200 of order_', {_S('o_custkey')}, ' from ', o_orderpriority) END"
LANG = "CASE o_orderkey % 4 WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' ELSE 'txt' END"
_SRC = f"SELECT o_orderkey AS k, o_custkey, o_orderstatus, {EXT} AS ext, {LANG} AS lang, {CODE} AS code FROM orders"
_KNOWN = {"time": "time", "jason": "x/jason", "log": "x/log", "cache": "x/cache", "json": "encoding/json"}
_IMPORTS = ("time", "encoding/json", "x/log")

_words = lambda values: ", ".join(f"'{v}'" for v in values)
_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(code, '//[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g'), '"(?:\\.|[^"\\])*"', '', 'g'), '''(?:\\.|[^''\\])*''', '', 'g'), '`[^`]*`', '', 'g')"""
_Q, _C = r"\b[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*\b", r"\b[A-Z][A-Za-z0-9_]*\b"
_ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)".format
_JOIN = "array_to_string({}, '|')".format


def _source(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderstatus", F.expr(EXT).alias("ext"), F.expr(LANG).alias("lang"), F.expr(CODE).alias("code"))


def _joined(column):
    return F.array_join(column, "|")


def _map(known):
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])


_GUESS = "CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in go.GUESSED.items()) + " END"
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _KNOWN.items()) + "}"


@query(f"""WITH s AS ({_SRC}), c AS (SELECT k, code, {_CLEAN} AS clean FROM s), q AS (SELECT *, regexp_extract_all(clean, '{_Q}') AS q, regexp_extract_all(clean, '{_C}') AS c FROM c)
  SELECT k, clean, {_JOIN(_ONCE('q'))} AS qualified, {_JOIN(_ONCE('c'))} AS capitalized, regexp_extract(code, '(?m)^package\\s+([A-Za-z0-9_]+)', 1) AS package,
    {_JOIN(f"list_sort(list_distinct(list_filter(list_concat(q, c), lambda x: x NOT IN ({_words(go.BUILTINS + go.PROSE)}) AND (contains(x, '.') OR length(x) >= 3 AND regexp_matches(x, '[a-z]')))))")} AS referenced,
    {_JOIN(f"list_sort(list_distinct(list_filter(list_transform(list_transform(q, lambda x: split_part(x, '.', 1)), lambda p: CASE WHEN map_contains({_MAP}, p) THEN {_MAP}[p] ELSE {_GUESS} END), lambda y: y IN ({_words(_IMPORTS)}))))")} AS imports
  FROM q""")
def go_names(spark, sf_dir):
    """Cleaned code, identifiers, symbols referenced and the imports they need."""
    clean = go.clean(F.col("code"))
    imports = F.array(*[F.lit(i) for i in _IMPORTS])
    return _source(spark, sf_dir).select(
        "k", clean.alias("clean"), _joined(go.qualified(clean)).alias("qualified"), _joined(go.capitalized(clean)).alias("capitalized"), go.package(F.col("code")).alias("package"),
        _joined(go.referenced(F.col("code"))).alias("referenced"), _joined(go.minimal_imports(F.col("code"), imports, _map(_KNOWN))).alias("imports"),
    )


_LIST = "CASE o_orderkey % 3 WHEN 0 THEN array() WHEN 1 THEN array('time') ELSE array('a', 'b', 'c', 'd', 'e', o_orderstatus) END"
_KIND = "CASE o_orderkey % 5 WHEN 0 THEN 'method' WHEN 1 THEN 'function' WHEN 2 THEN 'type' WHEN 3 THEN 'header' ELSE 'block' END"
_RECV = "CASE o_custkey % 4 WHEN 0 THEN concat('s *Order', o_orderstatus) WHEN 1 THEN concat('s pkg.Order', o_orderstatus) WHEN 2 THEN 'Order' ELSE '' END"
_NUM = "o_custkey % 90 AS a, o_custkey % 90 + o_orderkey % 400 AS b, o_orderkey % 70 AS c, o_orderkey % 70 + o_custkey % 300 + 1 AS d"
_DUCK_LIST = _LIST.replace("array()", "[]::VARCHAR[]").replace("array('time')", "['time']").replace("array('a', 'b', 'c', 'd', 'e', o_orderstatus)", "['a', 'b', 'c', 'd', 'e', o_orderstatus]")
_LABEL = "CASE " + " ".join("WHEN " + " AND ".join("(" + " OR ".join(f"contains(lower(code), '{w}')" for w in g) + ")" for g in groups) + f" THEN '{label}'" for label, groups in go.BLOCKS) + " ELSE 'block' || (k % 6 + 1) END"


@query(f"""WITH s AS (SELECT o_orderkey AS k, {CODE} AS code, {_DUCK_LIST} AS imports, {_KIND} AS kind, {_RECV} AS receiver, 'N' || o_orderstatus AS name, {_NUM} FROM orders),
  r AS (SELECT *, string_split_regex(receiver, '\\s+') AS w, CASE WHEN d - c > 0 THEN (b - a)::DOUBLE / (d - c) * 100 ELSE 100 END AS covered, greatest(CASE WHEN a % 2 = 0 THEN c ELSE 0 END, CASE WHEN a % 3 = 0 THEN d - 1 ELSE CASE WHEN a % 2 = 0 THEN c ELSE 0 END END) AS border FROM s),
  t AS (SELECT *, CASE WHEN kind NOT IN ('method', 'function') THEN '' WHEN covered > 85 THEN 'complete' WHEN a - c < 30 THEN CASE WHEN covered < 15 AND b - a < 200 THEN 'signature' ELSE 'mixed' END ELSE 'body' END AS role,
     list_last(string_split(ltrim(list_last(w), '*'), '.')) AS rtype FROM r)
  SELECT k, 'package p' || name || CASE WHEN len(imports) = 1 THEN chr(10) || 'import "' || imports[1] || '"' WHEN len(imports) > 1 THEN chr(10) || 'import (' || chr(10) || array_to_string(list_transform(imports[1:5], lambda x: '    "' || x || '"' || chr(10)), '') || ')' ELSE '' END
      || CASE WHEN kind = 'method' AND receiver <> '' THEN chr(10) || '// receiver: ' || receiver ELSE '' END AS context,
    CASE WHEN len(w) < 2 THEN receiver ELSE '(' || w[2] || ')' END AS receiver_form, rtype AS receiver_type, role,
    CASE kind WHEN 'method' THEN 'go:method:' || CASE WHEN contains(receiver, '*') THEN '(*' ELSE '(' END || rtype || ').' || name || CASE WHEN role <> '' THEN '/' || role ELSE '' END
      WHEN 'function' THEN 'go:function:' || name || CASE WHEN role <> '' THEN '/' || role ELSE '' END WHEN 'type' THEN 'go:type:' || coalesce(nullif(rtype, ''), name) || ' (unknown)' ELSE 'go:block' END AS path,
    CASE kind WHEN 'header' THEN 'go:file_header' WHEN 'type' THEN 'go:type:' || CASE WHEN rtype <> '' THEN rtype || ' (struct)' ELSE '' END
      WHEN 'method' THEN 'go:method:' || CASE WHEN receiver <> '' THEN '(' || receiver || ').' || name ELSE '' END WHEN 'function' THEN 'go:function:' || name ELSE 'go:block' END AS old_path,
    c > 0 AND a % 2 = 0 AND a < border AND (least(b, border) - greatest(a, 0) > (b - a) * 0.3 OR b <= border) AS header, {_LABEL} AS label,
    'Go package ' || regexp_extract(code, '(?m)^package\\s+([A-Za-z0-9_]+)', 1) || CASE WHEN k % 4 = 0 THEN ', with 1 type, 1 method, 1 function' ELSE '' END || '.' AS synopsis
  FROM t""")
def go_context(spark, sf_dir):
    """Header context, receivers, roles, paths, header test, labels and file synopsis of made-up chunks."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", f"{CODE} AS code", f"CAST({_LIST} AS array<string>) AS imports", f"{_KIND} AS kind", f"{_RECV} AS receiver", "concat('N', o_orderstatus) AS name", *_NUM.split(", "))
    kind, name, receiver = F.col("kind"), F.col("name"), F.col("receiver")
    rows = rows.withColumn("rtype", go.receiver_type(receiver)).withColumn("role", go.chunk_role(kind, F.col("c"), F.col("d"), F.col("a"), F.col("b")))
    node = F.when(kind == "header", "package_declaration").when(kind.isin("type", "method", "function"), F.concat(kind, F.lit("_declaration"))).otherwise(kind)
    return rows.select(
        "k", go.header_context(F.concat(F.lit("p"), name), F.col("imports"), kind, receiver).alias("context"), go.receiver_form(receiver).alias("receiver_form"), F.col("rtype").alias("receiver_type"), "role",
        go.node_path(kind, name, receiver, F.col("rtype"), F.lit(None).cast("string"), F.col("role")).alias("path"), go.syntax_path(node, name, receiver, F.col("rtype"), F.lit("struct")).alias("old_path"),
        go.in_header(F.when(F.col("a") % 2 == 0, F.col("c")).otherwise(F.lit(0)), F.when(F.col("a") % 3 == 0, F.col("d")), F.col("a"), F.col("b")).alias("header"),
        go.block_label(F.col("code"), F.col("k") % 6).alias("label"), go.synopsis(F.col("code")).alias("synopsis"),
    )


_UPPER = " , ".join(f"regexp_extract_all(code, '\\b([A-Z][a-zA-Z0-9_]*)\\s*{end}', 1)" for end in (r"\{", r"\(", r"\[", r"\)", ",", ":", "=", ";", r"\z", "interface", "struct")) + r", regexp_extract_all(code, '\*\s*([A-Z][a-zA-Z0-9_]*)', 1)"
_LOWER = r"regexp_extract_all(code, '\b([a-z][a-zA-Z0-9_]*)\s*interface', 1), regexp_extract_all(code, '\b([a-z][a-zA-Z0-9_]*)\s*struct', 1), regexp_extract_all(code, '\b([a-z][a-zA-Z0-9_]*)\s*\)', 1), regexp_extract_all(code, '\*\s*([a-z][a-zA-Z0-9_]*)', 1), regexp_extract_all(code, '(?m)\s([a-z][a-zA-Z0-9_]*)\s*$', 1), regexp_extract_all(code, '\s([a-z][a-zA-Z0-9_]*)\s*//', 1)"


@query(f"""WITH s AS ({_SRC}), q AS (SELECT k, code, list_filter(regexp_extract_all(code, '{_Q}'), lambda x: map_contains({_MAP}, split_part(x, '.', 1))) AS known, flatten([{_UPPER}]) AS up, list_filter(flatten([{_LOWER}]), lambda x: x NOT IN ({_words(go.TYPE_WORDS)})) AS low FROM s)
  SELECT k, {_JOIN(f"list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(code, '[a-zA-Z_][a-zA-Z0-9_]*'), lambda x: x NOT IN ('error', 'nil', 'true', 'false')), lambda x: {_MAP}[x]), lambda x: x IS NOT NULL)))")} AS imports,
    {_JOIN("list_sort(list_distinct(list_concat(known, list_filter(list_concat(list_concat(up, low), CASE WHEN contains(code, 'error') THEN ['error'] ELSE [] END), lambda x: NOT list_contains(list_transform(known, lambda y: split_part(y, '.', 2)), x)))))")} AS symbols
  FROM q""")
def go_strict_symbols(spark, sf_dir):
    """Imports by identifiers, and symbols by the places where types stand."""
    return _source(spark, sf_dir).select("k", _joined(go.used_imports(F.col("code"), _map(_KNOWN))).alias("imports"), _joined(go.strict_symbols(F.col("code"), _map(_KNOWN))).alias("symbols"))


_CLASS = {"py": r"'(?m)^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\s*[:(]'", "ts": r"'(?m)^\s*(?:export\s+)?class\s+([A-Za-z_][A-Za-z0-9_]*)\b'"}
_FUNCS = {
    "py": [r"'(?m)^\s*def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\('"],
    "ts": [r"'(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_][A-Za-z0-9_]*)\s*\('", r"'(?m)^\s*const\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:async\s+)?\('"],
    "go": [r"'(?m)^\s*func\s+(?:\([^)]+\)\s*)?([A-Za-z_][A-Za-z0-9_]*)\s*\('"],
}
_X = "regexp_extract_all(code, {}, 1)".format
_HAS = lambda text, ws: "(" + " OR ".join(f"contains({text}, '{w}')" for w in ws) + ")"


@query(f"""WITH s AS ({_SRC}),
  d AS (SELECT *, string_split(code, chr(10)) AS l, CASE ext WHEN 'py' THEN {_X(_CLASS['py'])} WHEN 'ts' THEN {_X(_CLASS['ts'])} ELSE [] END AS cls,
     CASE ext WHEN 'py' THEN {_X(_FUNCS['py'][0])} WHEN 'ts' THEN list_concat({_X(_FUNCS['ts'][0])}, {_X(_FUNCS['ts'][1])}) WHEN 'go' THEN {_X(_FUNCS['go'][0])} ELSE [] END AS fns FROM s),
  e AS (SELECT *, list_concat(cls, fns) AS defs0, coalesce(list_concat(cls, fns)[1], '') AS sym FROM d),
  f AS (SELECT *, {_ONCE('defs0')} AS defs, list_concat(defs0, list_filter(regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: length(x) >= 3)) AS syms FROM e)
  SELECT k, sym AS primary_symbol, CASE WHEN len(cls) > 0 THEN 'class' WHEN len(fns) > 0 THEN 'function' ELSE '' END AS primary_kind, {_JOIN('defs')} AS def_symbols, {_JOIN(f"({_ONCE('syms')})[1:256]")} AS symbols,
    CASE WHEN sym <> '' AND list_position(list_transform(l, lambda x: contains(x, sym) AND {_HAS('x', names.DEFINING)}), true) > 0 THEN 10 + list_position(list_transform(l, lambda x: contains(x, sym) AND {_HAS('x', names.DEFINING)}), true) - 1 ELSE 10 END AS span_start,
    coalesce(CASE WHEN ext = 'py' THEN nullif(regexp_extract(code, '(?ms)^\\s*\"\"\"(.*?)\"\"\"', 1), '') END, array_to_string(list_filter(l, lambda x: length(trim(x, ' ')) > 0), chr(10))) AS doc_head,
    CASE WHEN ext IN ('py', 'ts') AND contains(code, 'class ') THEN 'class_or_type' WHEN ext = 'go' AND contains(code, 'type ') AND contains(code, 'struct') THEN 'class_or_type' WHEN contains(code, 'import ') OR contains(code, 'from ') THEN 'imports' ELSE 'unknown' END AS kind,
    {_JOIN("list_filter(list_transform(l, lambda x: trim(x, ' ')), lambda x: ext = 'py' AND (starts_with(x, 'import ') OR starts_with(x, 'from ')) OR ext = 'ts' AND (starts_with(x, 'import ') OR starts_with(x, 'const ')) AND contains(x, 'require(') OR ext = 'go' AND starts_with(x, 'import '))")} AS imports,
    array_to_string(list_sort(list_concat(list_concat(CASE WHEN len(list_filter(l, lambda x: contains(lower(x), 'status') AND {_HAS('x', names.STATUS)})) > 0 THEN [{_words(names.STATUS)}] ELSE [] END, CASE WHEN {_HAS('lower(code)', [m.lower() for m in names.METHODS])} THEN [{_words(names.METHODS)}] ELSE [] END),
      list_concat(CASE WHEN ext = 'py' AND {_HAS('code', names.ERRORS)} THEN [{_words(names.ERRORS)}] ELSE [] END, CASE WHEN contains(lower(code), 'react') THEN ['React'] ELSE [] END)))[1:12], ', ') AS qa_terms,
    CASE WHEN ext = 'txt' THEN 'Txt code block with ' || len(l) || ' lines' WHEN ext = 'go' THEN 'Go code block with ' || len(l) || ' lines' WHEN ext = 'py' THEN 'Python code block with ' || len(l) || ' lines' ELSE 'Typescript code block with ' || len(l) || ' lines' END AS summary
  FROM f""")
def source_definitions(spark, sf_dir):
    """Definitions, symbols, span, head, kind, imports, terms and summary line of each text."""
    code, ext, lang = F.col("code"), F.col("ext"), F.col("lang")
    rows = _source(spark, sf_dir).withColumn("d", names.definitions(code, ext))
    return rows.select(
        "k", "d.primary_symbol", "d.primary_kind", _joined(F.col("d.def_symbols")).alias("def_symbols"), _joined(names.symbols(code, F.col("d.def_symbols"))).alias("symbols"),
        F.get(names.primary_span(code, F.col("d.primary_symbol"), F.lit(10), F.lit(99)), F.lit(0)).alias("span_start"), names.doc_head(code, lang).alias("doc_head"), names.ast_kind(code, lang).alias("kind"),
        _joined(names.import_lines(code, lang)).alias("imports"), names.qa_terms(code, lang).alias("qa_terms"), names.summary_line(code, lang, F.initcap(lang)).alias("summary"),
    )


@query(rf"""WITH s AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), i AS (SELECT doc_id, regexp_extract_all(text, '\b([A-Za-z_][A-Za-z0-9_]{{3,}})\b', 1) AS ids FROM s),
  o AS (SELECT doc_id, ids, {_ONCE('ids')} AS u FROM i), m AS (SELECT doc_id, list_concat(ids, flatten(list_transform(u, lambda t: list_transform(list_filter(list_concat(regexp_extract_all(t, '[A-Z]?[a-z]+'), string_split(t, '_')), lambda p: length(p) > 2), lambda p: lower(p))[1:2]))) AS found FROM o)
  SELECT doc_id, {_JOIN(f"({_ONCE('found')})[1:50]")} AS symbols FROM m WHERE doc_id NOT IN (SELECT doc_id FROM s WHERE regexp_matches(text, '[A-Z]{{2}}|[A-Z]\b|[^\x00-\x7F]'))
  UNION ALL SELECT doc_id, '' FROM s WHERE regexp_matches(text, '[A-Z]{{2}}|[A-Z]\b|[^\x00-\x7F]')""")
def mined_symbols(spark, sf_dir):
    """Identifiers and their parts; texts with other letters or runs of capitals, whose look-ahead SQL lacks, are shown empty."""
    odd = F.col("text").rlike(r"[A-Z]{2}|[A-Z](?![A-Za-z0-9_])|[^\x00-\x7F]")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.when(odd, F.lit("")).otherwise(_joined(names.mined_symbols(F.col("text"), F.lit("text")))).alias("symbols"))


_KW = "string_split_regex(text, '[.\n,]')[1:16]"
_TIDY = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(x), ' '), '\.[\pL\pN_]+$', ''), '[^\pL\pN_\s]', ' ', 'g'), '\s+', ' ', 'g'), ' ')"
_TAIL = "CASE WHEN len(list_filter(string_split(x, ' '), lambda w: w <> '')) > 4 THEN array_to_string(list_filter(string_split(x, ' '), lambda w: w <> '')[-4:], ' ') ELSE x END"


@query(rf"""WITH k AS (SELECT doc_id, {_KW} AS kw FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\t\r\x0B\f]')),
  a AS (SELECT doc_id, kw, list_filter(list_transform(list_transform(kw, lambda y: replace(trim(lower(y), ' '), '_', ' ')), lambda x: regexp_replace({_TAIL}, '[^\x00-\x7F]', '', 'g')), lambda z: length(z) >= 2 AND NOT contains(z, '/') AND NOT contains(z, '\') AND NOT contains(z, 'github.com') AND NOT contains(z, 'golang.org')) AS a,
    list_filter(list_transform(kw, lambda x: {_TIDY}), lambda x: NOT regexp_matches(x, '[_\pN]') AND len(string_split(x, ' ')) BETWEEN 2 AND 4 AND len(list_filter(string_split(x, ' '), lambda w: w IN ({_words(keywords.VERBS + keywords.FILLERS)}))) = 0) AS b FROM k)
  SELECT doc_id, {_JOIN(f"({_ONCE('a')})[1:10]")} AS linted, {_JOIN("list_sort(list_distinct(b))[1:8]")} AS nouns, {_JOIN(r"list_filter(kw, lambda x: NOT regexp_matches(x, '[^\x00-\x7F]'))")} AS english FROM a""")
def keyword_lint(spark, sf_dir):
    """Parts of sentences as keywords: cleaned, reduced to noun phrases, and the English ones."""
    rows = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & ~F.col("text").rlike(r"[\t\r\x0B\f]"))
    kw = F.slice(F.split("text", "[.\n,]"), 1, 16)
    return rows.select("doc_id", _joined(keywords.linted(kw)).alias("linted"), _joined(keywords.linted_nouns(kw)).alias("nouns"), _joined(keywords.english_keywords(kw)).alias("english"))


_FIRST = r"""regexp_replace(regexp_replace(regexp_replace(string_split_regex(text, '[.!?]+')[1], '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), '[")]+$', ''), '[ \t\n\x0B\f\r]+$', '')"""


@query(rf"""WITH f AS (SELECT doc_id, text, source, {_FIRST} AS f FROM documents WHERE text IS NOT NULL), g AS (SELECT *, left(f, 160) AS h, length(left(f, 160)) - strpos(reverse(left(f, 160)), ' ') AS b, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS ascii,
    regexp_extract_all(text, '[A-Z][a-z]{{2,}}') AS ids, doc_id % 5 AS m FROM f)
  SELECT doc_id, CASE WHEN length(f) <= 160 THEN f WHEN strpos(h, ' ') > 0 AND b > 100 THEN left(h, b) ELSE h END AS summary, CASE WHEN length(ascii) < length(text) * 0.85 THEN ascii ELSE text END AS english,
    CASE m WHEN 0 THEN 'Method ' || CASE WHEN doc_id % 2 = 0 THEN 'Doc.' ELSE '' END || 'run' WHEN 1 THEN 'Function run' WHEN 2 THEN 'Type run' WHEN 3 THEN 'Package/import header' ELSE 'Code chunk' END || ' — ' || CASE WHEN len(ids) > 0 THEN lower(array_to_string(ids[1:2], ' and ')) ELSE 'code' END || '.' AS fallback,
    contains(lower(text), 'overview') OR {" OR ".join(f"contains(lower(text), '{b}')" for b in keywords.BROAD)} AS broad, contains(text, 'Spotlight') OR contains(text, 'spotlight') AS spotlight
  FROM g""")
def summary_forms(spark, sf_dir):
    """First sentence, English form and fallback of a summary; broad questions and spotlights."""
    text = F.col("text")
    kind = F.expr("CASE doc_id % 5 WHEN 0 THEN 'method' WHEN 1 THEN 'function' WHEN 2 THEN 'type' WHEN 3 THEN 'header' ELSE 'block' END")
    ids = F.regexp_extract_all(text, F.lit("[A-Z][a-z]{2,}"), F.lit(0))
    receiver = F.when(F.col("doc_id") % 2 == 0, "d *Doc").otherwise("Doc")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(
        "doc_id", keywords.normalized_summary(text).alias("summary"), keywords.english_summary(text).alias("english"), keywords.fallback_summary(kind, F.lit("run"), receiver, ids).alias("fallback"), keywords.is_broad(text).alias("broad"), keywords.has_spotlight(text).alias("spotlight"),
    )


_PATH = "'/repo/' || replace(p_name, ' ', '/') || CASE p_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '_test.go' WHEN 2 THEN '.TS' WHEN 3 THEN '/tests/a.rb' ELSE '.txt' END"


@query(rf"""WITH p AS (SELECT p_partkey, p_name, p_type, {_PATH} AS path, CASE p_partkey % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'tsx' ELSE 'md' END AS ext FROM part)
  SELECT p_partkey, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_type), '[^\pL\pN_-]+', '-', 'g'), '-{{2,}}', '-', 'g'), '-'), ''), 'repo') AS slug,
    array_to_string(list_filter(string_split(regexp_replace(path, '(?i)\.(py|js|jsx|ts|tsx|php|rb|go|css)$', ''), '/'), lambda s: s NOT IN ('', '.')), '.') AS module, substr(path, 7) AS rel_path, path AS elsewhere,
    contains(lower(path), '/tests/') OR contains(lower(path), '/test/') OR contains(lower(path), 'test_') OR contains(lower(path), '_test.') OR contains(lower(path), '/__tests__/') AS test, CASE ext WHEN 'py' THEN 'python' WHEN 'tsx' THEN 'typescript' ELSE ext END AS lang, CASE ext WHEN 'py' THEN 'python' WHEN 'tsx' THEN 'typescript' ELSE 'unknown' END AS known
  FROM p""")
def path_names(spark, sf_dir):
    """Slugs, modules, relative paths, test paths and languages."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "p_type", f"{_PATH} AS path", "CASE p_partkey % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'tsx' ELSE 'md' END AS ext")
    path = F.col("path")
    return rows.select(
        "p_partkey", names.slug(F.concat_ws(" & ", "p_name", "p_type")).alias("slug"), names.module_name(path).alias("module"), names.relative_path(path, F.lit("/repo/")).alias("rel_path"), names.relative_path(path, F.lit("/other")).alias("elsewhere"),
        names.is_test_path(path).alias("test"), names.language_of(F.col("ext")).alias("lang"), names.language_of(F.col("ext"), F.lit("unknown")).alias("known"),
    )


_COUNT = lambda hints: "len(list_filter([" + _words(hints) + "], lambda h: contains(lower(q), h)))"
_LANGS = "[" + ", ".join(_COUNT(h) for h in names.HINTS.values()) + "]"
_ASK = "concat(coalesce(text, ''), CASE conv_id % 4 WHEN 0 THEN ' in python with pytest, see src/app/main.py and a/b.go' WHEN 1 THEN ' Does the react node test call get_user in view.tsx' ELSE '' END)"


@query(rf"""WITH q AS (SELECT conv_id, turn, {_ASK} AS q FROM conversations),
  a AS (SELECT *, list_filter(regexp_extract_all(q, '\b[A-Za-z_][A-Za-z0-9_]*\b'), lambda x: length(x) >= 3) AS n0, regexp_extract_all(q, '[\w./-]+\.(?:py|js|ts|tsx|go|rb|php|java|scala|rs|cpp|c)\b') AS f0, {_LANGS} AS c, list_filter(regexp_extract_all(lower(q), '[a-z]+'), lambda w: length(w) >= 4)[1:6] AS t FROM q),
  b AS (SELECT *, {_ONCE('n0')} AS n, {_ONCE('f0')} AS f, CASE WHEN list_max(c) > 0 THEN [{_words(names.HINTS)}][list_position(c, list_max(c))] ELSE '' END AS lang FROM a)
  SELECT conv_id, turn, lang AS language, {_JOIN('n[1:10]')} AS identifiers, {_JOIN('f[1:8]')} AS file_hints, {_JOIN('list_filter(t, lambda w: NOT list_contains(n, w))')} AS keywords, CASE WHEN contains(lower(q), 'test') THEN '' ELSE '*test*' END AS negative_hints,
    {_JOIN("list_concat(list_concat(flatten(list_transform(n[1:6], lambda s: ['primary_symbol:' || s || '^8', 'symbols:' || s || '^6'])), list_transform(f[1:4], lambda x: 'rel_path:' || x || '^3')), CASE WHEN lang <> '' THEN ['language:' || lang || '^2'] ELSE [] END)[1:12]")} AS should,
    {_JOIN('CASE WHEN len(n) > 0 THEN n[1:3] ELSE t END')} AS router_terms, CASE WHEN turn % 2 = 0 THEN 'asked anew' ELSE regexp_replace(q, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') END AS clarified_query
  FROM b WHERE NOT regexp_matches(q, '[^\x00-\x7F]') UNION ALL SELECT conv_id, turn, '', '', '', '', '', '', '', '' FROM b WHERE regexp_matches(q, '[^\x00-\x7F]')""")
def question_plans(spark, sf_dir):
    """Plans of the questions, laid over by a model's rephrasing of every other turn; other alphabets, whose word borders differ between the engines, are shown empty."""
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_ASK).alias("question"))
    given = F.struct(F.when(F.col("turn") % 2 == 0, F.lit("asked anew")).otherwise(F.lit(" ")).alias("clarified_query"), F.array().cast("array<string>").alias("identifiers"))
    plans = planner.merge_plans(planner.heuristic_plan(asked).withColumn("model", given))
    plain = ~F.col("question").rlike(r"[^\x00-\x7F]")
    text = lambda c: F.when(plain, c).otherwise(F.lit(""))
    clauses = F.transform("bm25_should", lambda s: F.concat(s["field"], F.lit(":"), s["term"], F.lit("^"), s["boost"].cast("string")))
    return plans.select(
        "conv_id", "turn", text(F.col("language")).alias("language"), *[text(_joined(F.col(c))).alias(c) for c in ("identifiers", "file_hints", "keywords", "negative_hints")], text(_joined(clauses)).alias("should"), text(_joined(F.col("router_terms"))).alias("router_terms"), text(F.col("clarified_query")).alias("clarified_query")
    )
