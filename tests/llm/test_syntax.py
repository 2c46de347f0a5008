"""Syntax repair: Python against its own parser, the other languages on small sources."""

import ast
import random

import pytest

from codestrata.llm.chart import ChartGrammar
from codestrata.llm.syntax import _GRAMMARS, shape, syntax_repairs, unit_edits
from codestrata.sources.scratch import Scratch


def edits(lang, text):
    s = shape(lang, text)
    return len(s.edits) + sum(n * unit_edits(lang, *k, 2) for k, (n, _) in s.units.items())


VALID = {
    "js": """import a, { b as c } from 'm';
export default class K extends Base {
  #x = 1; static y = [1, , 2];
  constructor(a = 1, ...rest) { super(a); this.z = /[/'"]+/.test(`t ${a ? `${b}` : '}'}`) }
  async *gen() { for await (const x of y) yield x }
  get v() { return this.#x }
}
const f = async ({ a, b: [c] }, d = {}) => ({ ...a, [c]: d, 'k': 1, m() { return 1 } })
for (let i = 0, n = 3; i < n; i++) if (i % 2) continue; else { break }
label: while (true) { do { x++ } while (x < 3) }
switch (x) { case 1: case 2: y(); break
  default: z() }
try { a?.b?.[c]?.(d) } catch { x ??= 1 } finally { delete a.b }
var g = function () { return void 0 }, h = x ? y : z
""",
    "ts": """import type { A } from './a';
export interface P<T extends object = {}> extends Q<T> { readonly a?: string; b(x: number): void; [k: string]: any }
type U = A | B[] | { a: Map<string, Array<number>> } | ((x: number) => void);
enum E { A = 1, B }
export abstract class C<T> extends D<T> implements I, J { private readonly a: Map<string, number[]> = new Map<string, number[]>(); constructor(private x: number) { super() } abstract m(): void; public get y(): T { return this.z as T } }
function isA<T>(x: unknown): x is A { return (x as any)!.a !== undefined }
@Component({ a: 1 }) class X { @Input() name: string; async run(a: number, b?: string): Promise<void> { const { c }: { c: number } = await f<number>(a); } }
const g = (a: number): string => { return `${a}` }
""",
    "java": """package a.b;
import java.util.*; import static a.B.c;
@A(x = 1) public final class K<T extends Comparable<T>> extends L<T> implements M, N {
  private static final int[] X = {1, 2, 3}; List<Map<String, ? super T>> y = new ArrayList<>();
  static { x = 1; }
  public K(int... a) throws E { super(a); this.y = null; }
  @Override public <R> R run(final Function<T, R> f, int[] b) { for (int i = 0, j = 1; i < 3 && j > 2; i++) { if (a) return (R) f.apply((T) b); else continue; }
    for (Map.Entry<String, T> e : y.entrySet()) { int v = e == null ? 1 : (int) 2L; }
    try (var in = open(); R r = q()) { x.forEach(z -> { z.go(); }); } catch (A | B ex) { throw new E("x", ex); } finally { }
    switch (v) { case 1: case 2: break; default: x(); } int k = switch (v) { case 1, 2 -> 3; default -> { yield 4; } };
    do { v <<= 1; } while (v < 3); Runnable r = () -> {}; Supplier<K> s = K::new; return b instanceof int[] c ? null : a[1].x; }
  enum E { A(1) { void m() {} }, B; int q; } interface I { void m(); default int n() { return 1; } } record R(int a, String b) { }
}
""",
    "go": """package a

import (
	"fmt"
	x "a/b"
)

const (
	A = iota
	B
)

type T[K comparable] struct {
	a, b int `json:"a"`
	*U
	m map[string][]func(int) error
}

type I interface {
	M(a int, b ...string) (int, error)
	~int | string
}

func (t *T[K]) Run(a, b int, f func(x int) bool) (n int, err error) {
	if v, ok := t.m["a"]; ok && v != nil {
		return 0, nil
	} else if a > b {
		goto end
	}
	for i := 0; i < 3; i++ {
		for k, v := range t.m { fmt.Println(k, v...) }
	}
	switch y := z.(type) {
	case int, string:
		fallthrough
	default:
		defer func() { recover() }()
	}
	select {
	case m := <-c:
		c <- m
	}
	p := &T[int]{a: 1, b: []int{1, 2}[0]}
	go run(p)
end:
	return
}
""",
}


@pytest.mark.parametrize("lang", sorted(VALID))
def test_valid_sources_need_no_edits(lang):
    s = shape(lang, VALID[lang])
    assert s.edits == []
    assert [k for k in s.units if unit_edits(lang, *k)] == []


@pytest.mark.parametrize("lang", sorted(VALID))
def test_damage_is_found(lang):
    lines = VALID[lang].split("\n")
    for i in (3, len(lines) // 2):
        assert edits(lang, "\n".join(lines[:i] + ["<<<<<<< HEAD"] + lines[i:]))
        assert edits(lang, "\n".join(lines[:i] + ["}}}}"] + lines[i:]))
    assert edits(lang, VALID[lang] + "\n  call(5, ")
    assert edits(lang, VALID[lang] + "\n/* open")
    assert edits(lang, "<!DOCTYPE html>\n<html><body><h1>1</h1></body></html>\n")
    assert edits(lang, "# Notes\n\nSome plain words that are no code at all, just prose.\n")


PY = '''"""Module."""
from . import a, b as c
from .x.y import (p, q as r,)
@deco(1, *a, k=2)
async def f(a, /, b: int = 1, *args, c=None, **kw) -> dict[str, int]:
    x, *y = [i for i in range(3) if i if not i], {**a, "k": lambda z=1, *w: z}
    async with a as b, c: await d
    match a:
        case [1, *_] | {"k": v} if v: pass
        case _: return
    try: x = y[1:2, ..., ::3]
    except* (A, B) as e: raise E from e
    else: pass
    finally: del x
    if (n := 1) > 2: print(f"{n!r}" "x")
    elif a is not None and b not in c or not d: pass
    else: x = a if b else c
    for i, in z: yield (yield)
    while True:
        x **= -1 @ y
        global g; assert x, "m"
class K[T](B, metaclass=M): x: int = 0; y: "s"
match = case = type = 1; print(match.x, type(case))
'''


def test_python_agrees_with_its_parser():
    assert edits("py", PY) == 0
    ast.parse(PY)
    rng = random.Random(9)
    lines = PY.split("\n")
    checked = 0
    for _ in range(300):
        i = rng.randrange(len(lines) - 1)
        new = list(lines)
        kind = rng.randrange(4)
        if kind == 0:
            new = new[:i] + [new[i][: rng.randrange(len(new[i]) + 1)]]
        elif kind == 1:
            del new[i]
        elif kind == 2:
            at = rng.randrange(len(new[i]) + 1)
            new[i] = new[i][:at] + rng.choice(["(", "]", ":", "+", "'", " def "]) + new[i][at:]
        else:
            new[i] = "  " + new[i]
        text = "\n".join(new)
        try:
            compile(text, "x", "exec", ast.PyCF_ONLY_AST)
            valid = True
        except SyntaxError:
            valid = False
        # what the grammar calls damaged must be so; it may take a little more than the language does
        if edits("py", text):
            assert not valid, text
            checked += 1
    assert checked > 80


def test_chart_counts_edits():
    g = ChartGrammar("S -> E ;\nE -> T | T + E\nT -> n | ( E )")
    for text, want in [("n ;", 0), ("n + n ;", 0), ("", 2), ("n + ;", 1), ("n n ;", 1), ("( n ;", 1), ("n ; n", 1), ("+ + ;", 2), ("; n n n n n n", 3)]:
        t = text.split()
        assert (g.error_at(t, "S") is None) == (want == 0)
        assert g.repair(t, "S", 2) == want
        assert g.damaged_runs(t, 3) <= want


def test_repairs_of_files(spark):
    rows = [
        ("ok", "a.py", PY), ("cut", "b.js", VALID["js"] + "\n  call(5, "), ("conflict", "c.py", PY + "<<<<<<< HEAD\nx = 1\n"),
        ("wrong", "d.java", VALID["go"]), ("empty", "e.py", ""), ("go", "f.go", ""), ("none", "g.py", None), ("other", "h.txt", "x x"), ("path", None, "x"),
    ]
    df = spark.createDataFrame(rows, "file_id string, relative_path string, source string")
    got = {r["file_id"]: r for r in syntax_repairs(df, Scratch(spark, "t")).collect()}
    assert set(got) == {"ok", "cut", "conflict", "wrong", "empty", "go"}
    assert got["ok"]["edits"] == got["empty"]["edits"] == 0 and got["ok"]["kind"] is None
    assert got["go"]["edits"] == 1
    assert [got[k]["kind"] for k in ("cut", "conflict", "wrong")] == ["truncation", "conflict", "mismatch"]
    assert syntax_repairs(df.limit(0), Scratch(spark, "t")).count() == 0


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_exact_repair_equals_brute_force():
    g = ChartGrammar("S -> E ;\nE -> T | T + E\nT -> n | ( E )")
    known = {"E": {("n",)}, "T": {("n",)}}
    for _ in range(6):  # all sentences of up to nine tokens
        e = known["T"] | {t + ("+",) + r for t in known["T"] for r in known["E"]}
        t = {("n",)} | {("(",) + r + (")",) for r in known["E"]}
        known = {"E": {x for x in e if len(x) <= 9}, "T": {x for x in t if len(x) <= 9}}
    sentences = [x + (";",) for x in known["E"]]
    rng = random.Random(6)
    for _ in range(60):
        tokens = [rng.choice("n + ( ) ; !".split()) for _ in range(rng.randrange(7))]
        want = min(_distance(tokens, x) for x in sentences)
        assert g.repair(tokens, "S") == want
        assert g.repair(tokens, "S", 2) == min(want, 3)
        ahead, behind = g._bounds(tokens)
        assert max(behind[0], ahead[-1]) <= want


@pytest.mark.parametrize("lang, text, cost", [
    ("js", "f(a;\n", 2), ("js", "f(a));\n", 1), ("java", "class A { int x = 'abc; }", 3), ("py", "x = (1\n", 1), ("py", "x = 1)\n", 1),
    ("go", "package a\nfunc f() {\n", 1), ("py", "x = 'a\n", 1), ("py", "a b c d\n", 3),
])
def test_damage_is_repaired_in_place(lang, text, cost):
    s = shape(lang, text)
    units = sum(n * unit_edits(lang, *k) for k, (n, _) in s.units.items())
    assert units <= cost and units > 0
    assert not [w for w, _ in s.edits if w not in ("string", "bracket", "end")]


def test_whole_chart_equals_brute_force_and_search():
    # "O" can be empty, "A" is left-recursive and "X" a chain that tokens put in lead around
    g = ChartGrammar("S -> A ; | X | O\nA -> A , T | T\nT -> n O | ( A )\nO -> O ! |\nX -> Y\nY -> if S else Y | n")
    known = {h: set() for h in g.start}
    rules = [(sorted(g.start)[h], [sorted(g.start)[s] if isinstance(s, int) else s for s in body]) for h, body in g.rules]
    for _ in range(9):  # all sentences of up to eight tokens
        for head, body in rules:
            made = {()}
            for s in body:
                made = {x + y for x in made for y in (known[s] if s in known else {(s,)}) if len(x) + len(y) <= 8}
            known[head] = known[head] | made
    rng = random.Random(4)
    for _ in range(80):
        tokens = [rng.choice("n , ( ) ; ! if else ?".split()) for _ in range(rng.randrange(5))]
        for starts in (["S"], ["A"], ["A", "X"]):
            want = min(_distance(tokens, x) for s in starts for x in known[s])
            assert g.fill(tokens, starts) == g.repair(tokens, "|".join(starts)) == min(g._best_first(tokens, s) for s in starts) == want
    for n in (50, 130):  # beyond the lengths that are always filled, and beyond what fits the smallest numbers
        tokens = ["n", ","] * (n // 2) + ["?", "n", ";"]
        assert g.fill(tokens, ["S"]) == g.repair(tokens, "S") == 1
        assert g._best_first(tokens, "S", None, 10) is None


@pytest.mark.parametrize("lang, start, tokens", [("java", "Mem", "n " * 20), ("py", "S", "n " * 24), ("js", "L|S", "n , " * 3 + "< n n " * 3), ("go", "Top", "o n n 0 " * 4), ("ts", "It|S", ": n < " * 4)])
def test_chart_and_search_agree_on_foreign_text(lang, start, tokens):
    want = unit_edits(lang, start, tokens)
    grammar = _GRAMMARS[lang]
    assert want == min(grammar._best_first(tokens.split(), s) for s in start.split("|") if s in grammar.start)
