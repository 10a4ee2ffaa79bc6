"""Declarations by tokens: what stands in strings, comments, templates and functions isn't one."""

import random
import re
import time

import pytest

from tesserine.functions import chunkers, go, lexer

GO = '''package main

import "fmt"

var s = `
func no() {}
type X struct {}
`
/* func no2() {
*/
// type Z int
func (s *pkg.Service[T]) Run(x interface{ A() }, f func(int) string) (struct{ a int }, error) {
	a := "func x() {"
	type inner struct { b int }
	return '}', nil // }
}
type (
	A struct {
		x struct { y int }
	}
	B = string
	C [5]int; D map[string]pkg.T
	E[T any] interface{ F() }
	F pkg.G
)
func ext(a int) int
func G[T any](x T) { }
var v = struct{ a int }{1}
type Q int
'''
JS = '''import a from "b";
const r = /function x\\(\\) {/g;
const t = `function no() { ${ (() => { return `class Z {}` })() } } class N {}`;
// class No {}
export class A {
  m() {
    return { a: 1 };
  }
  n = (a) => { function inner() {} }
}
async function f(a, {b}) {
  class Inner {}
}
const g = async (x) => x / 2 / 3;
if (a) {
  b();
}
const o = { a: 1, class: 2, f: function () { } };
o.import(3); import("x");
'''
PY = '''import os
from a import b
"""
class No:
    def no(): pass
"""
@dec
def f(x, y={"a": [1,
  2]}, z=":"):
    import inner
    class Inner: pass
    s = "def x():"
class A(B):  # def no
    x = 1
    async def m(self):
        def n(): pass
    def k(self): pass
if True: import q
x = [i for i in y]; import z
'''
PHP = '''<html>function a() {}<?php
namespace A;
# function no() {}
abstract class K extends X {
  public static function a() { function b() {} $c = function () { }; }
  private function c() {}
}
$x = "function d() {";
$y = <<<EOT
class No {}
EOT;
interface I {}
new class {};
function &e() {}
?>
class No2 {}
'''
RB = '''# class No
module M
  class A < B
    def m(x)
      s = "def no"
      begin
        x
      end
    end
  end
end
=begin
def no
=end
x = <<~SQL
  def no
SQL
def z; end
'''
CSS = '''/* a { } */
div p, .x a { color: red; background: url("a {") }
.only { b: c }
@media (min-width: 1px) {
  h1 { a: b }
}
'''


@pytest.mark.parametrize(
    ("ext", "text", "found", "remarks"),
    [
        ("go", GO, [0, 2, 11, 16, 25, 26, 27, 28], {8, 10, 14}),
        ("js", JS, [0, 2, 4, 5, 8, 10, 13, 14], {3}),
        ("py", PY, [0, 7, 12, 14, 16, 17, 18], {6, 12}),
        ("php", PHP, [1, 3, 4, 5, 11, 13], {2}),
        ("rb", RB, [1, 2, 3, 5, 17], {0, 11}),
        ("css", CSS, [1, 3, 4], {0}),
        ("ts", "interface A { b: string }\ntype B = { a: number };\nconst type = 1;\n", [0, 1], set()),
    ],
)
def test_points(ext, text, found, remarks):
    assert lexer.points(text, ext) == (found, remarks)


def test_tokens_are_the_text():
    """Every character but blanks is in one token, in order, for any text."""
    draw = random.Random(4)
    parts = ["'", '"', "`", "/*", "*/", "//", "#", "{", "}", "${", "\n", " ", "\\", "/", "a", "def ", "func ", "<<<A\n", "=begin\n", "=> ", "(", ")", "é", "\t", "0x1f", "?>", '"""']
    for _ in range(600):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 40)))
        for ext in ("go", "js", "py", "rb", "css", "php"):
            at = text.find("<?") if ext == "php" and "<?" in text else 0
            for t in lexer.tokens(text, ext):
                assert t.text == text[t.start : t.end] and t.line == text.count("\n", 0, t.start) and not text[at : t.start].strip(" \t\xa0")
                at = t.end
            assert not text[at:].strip(" \t")
            lexer.points(text, ext)
        chunkers.go_declarations(text)


def test_go_declarations():
    found = {d["name"]: d for d in chunkers.go_declarations(GO)}
    assert list(found) == ["Run", "A", "B", "C", "D", "E", "F", "ext", "G", "Q"]
    run = found["Run"]
    assert (run["kind"], run["receiver"], run["receiver_text"], run["type_name"], run["start_line"], run["end_line"]) == ("method", "*pkg.Service", "s *pkg.Service[T]", "Service", 12, 16)
    assert [found[n]["type_kind"] for n in "ABCDEFQ"] == ["struct", "alias", None, None, "interface", "alias", "alias"]
    data = ("// é漢\n" + GO).encode()
    for d in chunkers.go_declarations("// é漢\n" + GO):
        part = data[d["start_byte"] : d["end_byte"]].decode()
        assert part.startswith(("func", d["name"])) and d["name"] in part
    # a bracket that nothing closes costs its own declaration only
    assert [d["name"] for d in chunkers.go_declarations("type T struct {\nfunc A() {}\n\ntype B int\n")] == ["T", "A", "B"]
    assert lexer.go_header(GO)[0] == GO.index("// type Z int") + len("// type Z int") and lexer.go_header("var x = 1\n") == (0, None)


def test_time_is_linear():
    def took(n):
        texts = [("go", 'func f() { x := "}" }\n' * n), ("js", "`${" * n), ("js", "{" * 5 * n), ("js", "(" * n + ") => {" * n), ("go", "type (" * n), ("go", "func (" * n), ("py", "def f(\n" * n), ("php", "/*" * n)]
        begin = time.process_time()
        for ext, text in texts:
            lexer.points(text, ext)
        chunkers.go_declarations(texts[0][1])
        return time.process_time() - begin

    took(100)
    assert took(8000) < 14 * took(2000) + 0.5  # four times the text; a quadratic walk would take sixteen times as long


def test_packed_chunks_keep_every_line():
    draw = random.Random(2)
    for _ in range(200):
        blocks = [draw.choice(["func F%d() {\n" % i + "\tx()\n" * draw.randint(0, 40) + "}\n", "// note\n", "\n", "type T%d struct{}\n" % i, "var a = 1 + 2\n" * draw.randint(1, 6), "\ty := " + "z + " * draw.randint(0, 60) + "z\n"]) for i in range(draw.randint(0, 9))]
        text = "".join(blocks) + "// the tail"
        limit = draw.choice([5, 20, 60, 500])
        got = chunkers.packed_chunks(text, "go", limit)
        assert "".join("".join(c[3].split()) for c in got) == "".join(text.split())
        assert all(chunkers.count_tokens(c[3]) <= limit for c in got)
        assert [c[0] for c in got] == list(range(1, len(got) + 1)) and all(a[2] <= b[1] or a[1] <= b[1] for a, b in zip(got, got[1:], strict=False))
    assert chunkers.packed_chunks("", "go", 5) == []
    two = "func A() {\n\ta()\n}\n\nfunc B() {\n\tb()\n}\n"
    assert [c[1:3] for c in chunkers.packed_chunks(two, "go", 1000)] == [(1, 8)] and [c[1:3] for c in chunkers.packed_chunks(two, "go", 12)] == [(1, 4), (5, 8)]


def test_logical_parts():
    body = "\n".join(["func A() {"] + [f" x{i}()" for i in range(9)] + [" if x {", "  y", " }", " z()"] + [f" w{i}()" for i in range(30)] + ["}"])
    parts = chunkers.logical_parts(body, 100, 7)
    assert "\n".join(p[2] for p in parts) == body and parts[0][:2] == (7, 19) and parts[1][0] == 20
    assert chunkers.logical_parts("a b c d e", 2) == [(1, 1, "a b "), (1, 1, "c d "), (1, 1, "e")]


def test_go_chunks_of_a_file():
    got = chunkers.go_chunks(GO, 1000)
    assert [(c["kind"], c["name"], c["start_line"], c["end_line"]) for c in got][:3] == [("header", None, 1, 11), ("method", "Run", 12, 16), ("type", "A", 18, 20)]
    split = [c for c in chunkers.go_chunks(GO, 30) if c["name"] == "Run"]
    assert [c["part"] for c in split] == list(range(1, len(split) + 1)) and "".join("".join(c["text"].split()) for c in split) == "".join("".join(GO.split("\n")[11:16]).split())
    assert chunkers.go_chunks("", 10) == [] and [c["kind"] for c in chunkers.go_chunks("func A() {}", 10)] == ["function"]


def test_go_tokens_leave_out_braces():
    """As many tokens whatever the bodies hold, and the same declarations as from all tokens."""
    pieces = ["func ", "type ", "F ", "(", ")", "{", "}", "[", "]", "\n", "//c{\n", "/* { \n */", '"s{"', "'}'", "`r\n{`", "struct ", "import ", "=", ";", "+", "func A() {\n x += 1 }\n", "type (\n A struct { b int }\n B = c\n)\n"]
    rng = random.Random(5)
    texts = [GO, *["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(2000)]]
    for text in texts:
        every = list(lexer.tokens(text, "go"))
        assert lexer.go_declarations(text) == lexer.go_declarations(text, every) and lexer.go_header(text) == lexer.go_header(text, every), text
        assert {t for t in lexer.go_tokens(text) if t.kind == "c"} == {t for t in every if t.kind == "c"}, text
    body = lambda n: "func A(x int) {\n" + "\tif x { x += 1 }\n" * n + "}\n"
    assert len(lexer.go_tokens(body(500))) == len(lexer.go_tokens(body(1)))


def test_tokens_are_counted_without_a_list():
    rng = random.Random(6)
    signs = [chr(i) for i in range(128)] + ["é", "\u2028", "漢"]
    for n in range(500):
        text = "".join(rng.choice(signs[: 128 if n % 2 else None]) for _ in range(50))
        assert chunkers.count_tokens(text) == len(re.findall(r"\w+|[^\w\s]", text)), text


def test_packed_chunks_count_a_text_once(monkeypatch):
    """Texts of whole declarations within the limit aren't counted again once they are merged."""
    seen = []
    count = chunkers.count_tokens
    monkeypatch.setattr(chunkers, "count_tokens", counted := lambda text, encode=None: seen.append(text) or count(text, encode))
    text = "".join(f"func F{i}() {{\n\tx()\n}}\n" for i in range(6))
    assert len(chunkers.packed_chunks(text, "go", 1000, counted)) == 1 and seen and text not in seen


def test_known_chunks_are_those_of_the_walk():
    """Texts cut together, with plain functions taken by a pattern and tokens counted once, give the chunks of a walk over each; tokens and labels too."""
    pieces = ["package p\n", 'import "time"\n', "import (\nfunc x() {}\n)\n", "// note\n", "/* {\nfunc No() {}\n*/\n", "type T struct {\n\ta int\n}\n", "const s = `r\nfunc No() {}\n`\n", "\n", "func A() {}\n", "func (s *T) M(a []int) (int, error) {\n\tif x {\n\t\ty()\n\t}\n\treturn nil\n}\n",
              "func (T) N() struct{ a int } {\n}\n", "func D() interface{} { return 1 }\n", "func E() {\n\ts := \"}\"\n\tlog.Print(s) // }\n}\n", "func L() {\n" + "\tx += 1\n" * 20 + "}\n", "func K() {\n" + "\tif err := json.Marshal(a); err != nil {\n\t\treturn wrap(error)\n\t}\n" * 4 + "}\n", "func Half() {\n", ")\n", "func Ü() {}\n", "x\x1cy\n"]
    rng = random.Random(9)
    seen = set()
    for _ in range(1500):
        texts = ["".join(rng.choices(pieces if rng.random() < 0.4 else [pieces[0], *pieces[7:10], *pieces[12:15]], k=rng.randrange(9))) for _ in range(3)]
        limit = rng.choice([0, 1, 5, 17, 60, 1000])
        for text, got in zip(texts, chunkers._known_chunks(texts, limit), strict=True):
            assert [r[:-2] for r in got] == [tuple(c.values()) for c in chunkers.go_chunks(text, limit)], (text, limit)
            for r in got:
                low, known = r[9].lower(), r[10] is not None
                assert known == (text.isascii() and "\x1c" not in text) and (not known or r[10] == chunkers.count_tokens(r[9]))
                assert not known or not r[7] or r[11] == next((label for label, groups in go.BLOCKS if all(any(w in low for w in g) for g in groups)), None)
                seen.add(r[11])
            plain = lexer.go_plain(text)
            assert plain is None or plain == (lexer.go_header(text)[0], [d[:7] for d in lexer.go_declarations(text)]), text
    assert {None, "json_ops", "error_handling", "logging"} <= seen


def test_plain_functions_make_no_tokens(monkeypatch):
    """A file of clauses and plain functions is cut without the walk over its tokens."""
    text = 'package p\n\nimport "time"\n\n' + "func A(x int) error {\n" + "\tx += 1\n" * 40 + "\treturn nil\n}\n\n" * 1
    want = [tuple(c.values()) for c in chunkers.go_chunks(text, 30)]
    monkeypatch.setattr(lexer, "go_tokens", None)
    monkeypatch.setattr(chunkers, "count_tokens", None)
    assert [r[:-2] for r in chunkers._known_chunks([text], 30)[0]] == want and len(want) > 3
