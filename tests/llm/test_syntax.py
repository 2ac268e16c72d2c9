from __future__ import annotations

import pytest

from quarry.llm.p4 import unparsable
from quarry.llm.syntax import language_of, problem

GO = 'package a\n\nimport (\n\t"fmt"\n)\n\n// T keeps { one.\ntype T struct {\n\tA map[string]int `json:"a"`\n\tB *T\n}\n\nfunc (s *T) Run(a string, n int) (*T, error) {\n\tx := map[string]int{"k": 1, "l": 2}\n\tif c := \'{\'; a == "" || len(a) > n {\n\t\tfmt.Println(`raw {\n`, c, x[a:])\n\t}\n\tfor _, v := range s.list {\n\t\tgo func() { v <- 1 }()\n\t}\n\tswitch v := i.(type) {\n\tcase int, *T:\n\t\tbreak\n\tdefault:\n\t\treturn nil, fmt.Errorf("x: %w", err)\n\t}\n\treturn &T{A: nil}, nil\n}\n\nvar _ = []byte{\n\t0x1, 0x2,\n}\n'
RUST = '#![allow(dead_code)]\nuse std::collections::HashMap;\n\n#[derive(Debug)]\npub struct A<\'a> {\n    pub x: &\'a str,\n    y: HashMap<String, u32>,\n}\n\nimpl<\'a> A<\'a> {\n    pub fn f(&self, n: u64) -> Option<u64> {\n        match c {\n            Some(\'{\') | Some(\'"\') => d += 1,\n            Some(o) if o == \'\\\'\' => return None,\n            _ => {}\n        }\n        /* nested /* one */ ok { */\n        let t = r#"raw " { "#;\n        println!("{{}} {}", t);\n        let s = self.g(n, 3)?.iter().map(|x| x * 8).sum::<u64>();\n        Some(s)\n    }\n}\n\nextern "C" {\n    pub fn g(a: *mut u8) -> i32;\n}\n'
CS = 'using System;\n\nnamespace A.B\n{\n    /// <summary>x</summary>\n    public sealed class C\n    {\n        private readonly List<string> _a;\n        public string P { get; set; }\n\n        public async Task<int> F(string s, int n)\n        {\n#if DEBUG\n            Trace(s);\n#endif\n            var q = @"select ""a"" (\n  b";\n            var l = $"{s.Id}: {s.Name,12} {{raw}}";\n            foreach (var x in _a) { await G(x); }\n            switch (n) { case \'{\': d++; break; default: return 1; }\n            return n > 3 ? 1 : 2;\n        }\n    }\n}\n'
JS = "'use strict';\n\nconst a = require('./a');\n\nclass A {\n  constructor(x) {\n    this.x = [];\n  }\n\n  async f(a, b) {\n    const p = /[{(\"'][a-z]+\\/x/i;\n    const t = `x ${a.id} (\n  y`;\n    for (const v of this.x) {\n      await this.g(v, { limit: 1 });\n    }\n    if (!a || a.length > 3) return\n    return this.x.filter((x) => x.n > 1).map((x) => x.k);\n  }\n}\n\nmodule.exports = { A };\n"
PY = '"""Doc."""\nimport os\n\n\nclass A:\n    def f(self, *, n=0):\n        text = """\na (\n=======\n[\n        """\n        with open(p) as h:\n            return [x for x in h if x]\n'
GOOD = {"Go": GO, "Rust": RUST, "C#": CS, "JavaScript": JS, "Python": PY}


G = lambda b: 'package a\n\n' + b
WIDER = {'Go':[G('func f() {\n\tif err := g(x); err != nil {\n\t\treturn\n\t}\n\tfor i := 0; i < 3; i++ {\n\t\tx[i] = y\n\t}\n\tfor ; ; {\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tswitch x := y.(type) {\n\tcase A:\n\t\tz()\n\t}\n\tselect {\n\tcase v := <-ch:\n\t\tu(v)\n\tcase ch <- 1:\n\tdefault:\n\t}\n}\n'),
 G('type A interface {\n\tFoo(a, b int) (c string, err error)\n\tio.Reader\n}\n\ntype F func(int) string\ntype M map[string][]int\ntype G[T any, K comparable] struct {\n\tx T\n}\n\nfunc Map[T, U any](xs []T, f func(T) U) []U {\n\tout := make([]U, 0, len(xs))\n\tfor _, x := range xs {\n\t\tout = append(out, f(x))\n\t}\n\treturn out\n}\n'),
 G('const (\n\tA = iota\n\tB\n\tC\n)\n\nvar x, y = 1, "s"\n\nvar t = []struct {\n\tname string\n\twant int\n}{\n\t{"a", 1},\n\t{name: "b", want: 2},\n}\n\nfunc g() (n int, err error) {\n\tdefer func() {\n\t\tif r := recover(); r != nil {\n\t\t\terr = r.(error)\n\t\t}\n\t}()\n\tx := &T{\n\t\tA: 1,\n\t\tB: []int{1, 2},\n\t}\n\tgo h(func(a int) bool { return a > 0 }, -1, *p, &q)\nL:\n\tfor {\n\t\tcontinue L\n\t}\n\treturn a[1:2], f(xs...)\n}\n'),
 G('func f() {\n\tx := a.\n\t\tb().\n\t\tc(1,\n\t\t\t2)\n\tif a &&\n\t\tb {\n\t}\n\tm[k], ok = v, !w\n\tvar z *T = nil\n\tif v, ok := m[k]; ok && v.x == 1 {\n\t} else if z != nil {\n\t} else {\n\t}\n\tfn := func() {}\n\tfn()\n\tch := make(chan<- int)\n\tx.y.(*T).z++\n\tvar e struct{}\n\treturn\n}\n')],
'Rust':['use std::io::{self, Read};\n\nfn main() -> Result<(), Box<dyn Error>> {\n    let x = if a { 1 } else { 2 };\n    let Some(y) = z else { return Ok(()) };\n    if let Some(a) = b && c { d(); }\n    while let Some(x) = it.next() { }\n    let f = |a: i32, b| a + b;\n    let c = || 5;\n    for (i, x) in xs.iter().enumerate() { println!("{}", i); }\n    let r = &mut v[..];\n    let s = S { a, b: 1, ..Default::default() };\n    match x { 0..=9 => {}, n if n > 3 => return Ok(()), _ => unreachable!(), }\n    let t: Vec<_> = v.iter().map(|&x| x as u8).collect::<Vec<u8>>();\n    unsafe { *p = 1; }\n    let l = \'outer: loop { break \'outer 3; };\n    Ok(())\n}\n','pub(crate) struct A(pub u32, String);\npub enum E { A, B(i32), C { x: u8 } }\nimpl<T: Clone + \'static> Tr for A where T: X { type O = T; const N: usize = 3; fn f(self) -> Self::O { todo!() } }\nmacro_rules! m { ($x:expr) => { $x + 1 }; }\nstatic X: &str = "a\n b";\n#[cfg(test)]\nmod tests { use super::*; #[test] fn t() { assert_eq!(1, 1); } }\ntrait T2: A + B { fn f(&self); fn g(&self) -> i32 { 1 } }\nasync fn h() { x().await?; }\nconst F: fn(i32) -> i32 = g;\nlazy_static! { static ref A: i32 = 1; }\n'],
'C#':['using System;\nusing static A.B;\nusing X = Y.Z;\n\n[assembly: Foo("x")]\nnamespace N;\n\npublic record P(int X, string? Y = null);\n\npublic class C<T> : B, I<T> where T : class, new()\n{\n    private int? x = 3;\n    public event EventHandler? E;\n    public int this[int i] => a[i];\n    public static C operator +(C a, C b) => new C(a, b);\n    public C(int a) : base(a) { }\n    ~C() { }\n    [Obsolete]\n    public override string ToString() => $"{x:N2} {(a ? 1 : 2)}";\n    int F(ref int a, out var b, params int[] c)\n    {\n        var q = from i in xs where i > 3 orderby i select new { i, j = 2 };\n        if (o is string s && s.Length > 1) return (int)x;\n        var (a1, b1) = t;\n        foreach (var (k, v) in d) { }\n        for (int i = 0, j = 1; i < 3; i++, j--) { x ??= 1; }\n        var r = x switch { 1 => "a", > 3 => "b", _ => throw new Exception() };\n        try { } catch (Exception e) when (e.X) { } finally { }\n        Func<int, int> f = y => y + 1; Action g = () => { };\n        lock (o) { a?.b?[1]?.c(); }\n        int[] arr = { 1, 2 }; var z = new[] { 1 }; var w = default(int); label: goto label;\n        await foreach (var u in v) { yield return u; }\n        using var st = Open(); var n = (x, y); return -1;\n    }\n}\n'],
'JavaScript':['const { a, b: c = 1, ...rest } = require("x")\nlet x = a ? b : c, y = [1, , 2]\nfunction f(a = 1, { b }, ...c) { return a / b / c }\nconst g = async (x) => { await x }\nconst h = x => ({ a: x, [k]: 1, get z() { return 1 }, async m() {}, *gen() { yield 1 }, \'q\': 2, 3: 4, a })\nfor (let i = 0; i < 3; i++) { continue }\nfor (const k in o) if (k) break\nlabel: while (true) { break label }\nswitch (x) { case 1: { y() } case "a": z(); default: w() }\ntry { t() } catch { u() } finally { v() }\nclass A extends B { static #p = 1; x = 2; constructor() { super(); this.#p } get q() { return 1 } static async *r() {} }\nx = y?.z?.[0]?.(1) ?? `a${b + `c${d}`}e`\nif (!/ab+c[/]/.test(s)) delete o[k]\nconst re = s.replace(/\\//g, "")\nnew Foo\nvoid 0, typeof x === "u"\ni++\n--j\nexports.a = function () {}\n;(function () { return 1 })()\n!function () {}()\ndo { x-- } while (x > 0)\nthrow new Error("x")\nvar fn = function named(a) { }, o2 = { if: 1, class: 2 }.if\nasync function* ag() { for await (const x of y) {} }\n'],
}


@pytest.mark.parametrize("lang", WIDER)
def test_wider_valid_sources_pass(lang):
    for src in WIDER[lang]:
        assert problem(lang, src) is None


@pytest.mark.parametrize("lang", GOOD)
def test_valid_sources_pass(lang):
    assert problem(lang, GOOD[lang]) is None
    assert problem(lang, GOOD[lang].replace("\n", "\r\n")) is None
    assert problem(lang, "﻿" + GOOD[lang]) is None


@pytest.mark.parametrize("lang", GOOD)
def test_broken_sources_are_found(lang):
    src = GOOD[lang]
    half = src.index("(", len(src) // 2)
    assert problem(lang, src[: half + 1])
    lines = src.split("\n")
    conflict = "\n".join([*lines[:3], "<<<<<<< ours", "x", "=======", "y", ">>>>>>> theirs", *lines[3:]])
    assert problem(lang, conflict)
    assert problem(lang, "parcel id,carrier name,weight kg\n330207,noisy session,37.49\n")
    assert problem(lang, "00000000: b578 a256 699f bc55\n00000010: 51c3 17c0 db0b 6a0d\n")
    assert problem(lang, src + "\n}\n")
    assert problem(lang, src.replace("\n\n", "\n\n\x00\x01\n", 1))
    for other, text in GOOD.items():
        if other != lang:
            assert problem(lang, text), (lang, other)


def test_unterminated_literals_and_templates():
    assert problem("Go", 'package a\nvar x = "abc\n') == "unterminated literal"
    assert problem("Go", "package a\nfunc {{ .w }}() {\n}\n") and problem("C#", "class A { public void <%= w %>() { } }")
    assert problem("Rust", "pub fn {{w}}() {}\n") and problem("JavaScript", "{{ w }}() {}\n")
    assert problem("JavaScript", "import x from 'y';\n") and problem("JavaScript", "const x;\n")
    assert problem("Rust", "#[derive(Debug)]\n") and problem("Go", "package a\nimport")


def test_empty_and_comment_only_files():
    for lang in ("Python", "Rust", "C#", "JavaScript"):
        assert problem(lang, "") is None
    assert problem("Go", "") and problem("Go", "// only\n") and problem("Rust", "// only\n") is None and problem("C#", "/* x */") is None
    assert problem("Go", None) is None and problem(None, "x(") is None
    assert language_of("a/B.CJS") == "JavaScript" and language_of("a") is None and language_of(None) is None


def test_operator_on_a_table(spark):
    rows = [(1, "a.GO", "package a\n"), (2, "a.go", ""), (2, "a.go", ""), (3, "a.txt", "("), (None, "b.py", "x = ("), (4, None, "("), (5, "c.rs", None), (6, "d.py", "x = 1\n" * 200_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "id bigint, path string, content string, kind string")
    assert sorted((r.id or 0, r.language) for r in unparsable(df, "id", "path", "content").collect()) == [(0, "Python"), (2, "Go"), (2, "Go")]
    assert unparsable(df.limit(0), "id", "path", "content").count() == 0


@pytest.mark.parametrize(
    ("language", "text"),
    [
        ("Go", "package a\nfunc f() { if { x() } }\n"), ("Go", "package a\nfunc f() { x()\nelse { y() } }\n"), ("Rust", "fn f() -> { 3 }\n"), ("Rust", "fn f() { let = 3; }\n"),
        ("C#", "class A { void F() { int = 3; } }"), ("JavaScript", "if { }"), ("JavaScript", "function (a) { }"), ("JavaScript", "for (;;;) { }"),
    ],
)
def test_missing_parts(language, text):
    assert problem(language, text)


def test_long_signatures_and_bodies_are_read_whole():
    args = ", ".join(f"a{i} int" for i in range(60))
    assert problem("Go", f"package a\nfunc f({args}) error {{\n\treturn nil\n}}\n") is None
    body = "; ".join(f"a{i}()" for i in range(300))
    assert problem("JavaScript", f"x = function () {{ {body} }}\nfor (;;) {{ }}\n") is None
