from __future__ import annotations

from quarry.extract.structure import EXTRACTORS, records

GO = 'package a\n\ntype T struct {\n\tA int\n}\n\nfunc (s *T) Run(a string, n, m int) (*T, error) {\n\tif a == "" || n > 3 {\n\t\treturn nil, fmt.Errorf("x")\n\t}\n\thelp(n)\n\treturn s, nil\n}\n\nfunc help[X any](n X) {\n\tfor i := range n {\n\t\tprint(i)\n\t}\n}\n'
RUST = "pub struct A<'a> { x: &'a str }\nimpl<'a> A<'a> {\n    pub fn f(&self, n: u64) -> u64 {\n        if n > 1 && n < 3 { self.g(n) } else { help(n) }\n    }\n}\nimpl Tr for B { fn g(&self) { } }\nfn help(n: u64) -> u64 { n }\n"
CS = "namespace N\n{\n    public class C\n    {\n        private int _a;\n        public async Task<int> F(string s, int n)\n        {\n            foreach (var x in y) { await G(x); }\n            return this.H(n);\n        }\n        int P { get; set; }\n    }\n}\n"
PY = "import os\n\nclass C:\n    def f(self, a, *, b=1):\n        for x in a:\n            if x and b or a:\n                os.getenv(x)\n        return help(b)\n\ndef help(n):\n    return n\n"


def shape(lang, text):
    return {(k, n, r) for k, n, r, *_ in EXTRACTORS[lang](text)}


def test_go():
    assert shape("Go", GO) == {("type", "T", "struct"), ("function", "Run", "T"), ("call", "Errorf", "fmt"), ("call", "help", None), ("function", "help", None), ("call", "print", None)}
    run = next(r for r in EXTRACTORS["Go"](GO) if r[1] == "Run")
    assert run[4] == ["a", "n", "m"] and run[5:] == (7, 13, 2)


def test_rust():
    assert shape("Rust", RUST) == {("type", "A", "struct"), ("function", "f", "A"), ("call", "g", "self"), ("call", "help", None), ("function", "g", "B"), ("function", "help", None)}
    assert next(r for r in EXTRACTORS["Rust"](RUST) if r[1] == "f")[7] == 2


def test_csharp():
    assert shape("C#", CS) == {("type", "C", "class"), ("function", "F", "C"), ("call", "G", None), ("call", "H", "this")}
    f = next(r for r in EXTRACTORS["C#"](CS) if r[1] == "F")
    assert f[4] == ["s", "n"] and (f[5], f[6], f[7]) == (6, 10, 1)


def test_python():
    assert shape("Python", PY) == {("type", "C", "class"), ("function", "f", "C"), ("call", "getenv", "os"), ("call", "help", None), ("function", "help", None)}
    f = next(r for r in EXTRACTORS["Python"](PY) if r[1] == "f")
    assert f[4] == ["a", "b"] and f[7] == 4
    assert next(r for r in EXTRACTORS["Python"](PY) if r[1] == "getenv")[3] == "C.f"


def test_table(spark):
    rows = [(1, "Go", GO), (2, "Go", "func ("), (3, "Python", "x = ("), (4, "Rust", None), (5, "Perl", "x"), (6, "C#", ""), (7, None, "x")]
    df = spark.createDataFrame(rows, "file_id bigint, language string, content string")
    got = records(df)
    assert {(r.file_id, r.end_line) for r in got.filter("kind = 'parsed'").collect()} == {(1, 1), (2, 0), (3, 0), (6, 1)}
    assert {r.file_id for r in got.filter("kind <> 'parsed'").collect()} == {1}
    assert records(df.limit(0)).count() == 0
