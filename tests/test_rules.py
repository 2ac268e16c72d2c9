from __future__ import annotations

import pytest

from quarry.extract.facts import fact_id, facts_of, semantic_facts
from quarry.operators import rules

GO = "package a\n\nimport (\n\t\"net/http\"\n\t\"os\"\n\t\"os/exec\"\n\t\"database/sql\"\n\t\"bufio\"\n\t\"context\"\n\t\"crypto/md5\"\n\t\"crypto/sha1\"\n\t\"crypto/tls\"\n\t\"regexp\"\n\t\"sync\"\n\t\"time\"\n\t\"path/filepath\"\n\t\"github.com/gin-gonic/gin\"\n\t\"github.com/gofiber/fiber/v2\"\n\t\"gorm.io/gorm\"\n)\n\n"
# (name, language, body, rules that fire)
CASES = [
    ("sql", "Go", "func h(r *http.Request, db *sql.DB) {\n\tid := r.FormValue(\"id\")\n\tq := \"select \" + id\n\tdb.Exec(q)\n}\n", {"GO-SQL-SEC-001", "GO-COR-001"}),
    ("sqlok", "Go", "func h(r *http.Request, db *sql.DB) error {\n\tid := r.FormValue(\"id\")\n\t_, err := db.Exec(\"select ?\", id)\n\treturn err\n}\n", set()),
    ("sqlclean", "Go", "func h(r *http.Request, db *sql.DB) error {\n\tid := r.FormValue(\"id\")\n\tif !allowed(id) {\n\t\treturn nil\n\t}\n\t_, err := db.Exec(id)\n\treturn err\n}\n", set()),
    ("cmd", "Go", "func h(r *http.Request) {\n\texec.Command(r.FormValue(\"c\")).Run()\n}\n", {"GO-CMD-SEC-001"}),
    ("env", "Go", "func h() {\n\tc := os.Getenv(\"C\")\n\texec.Command(c).Run()\n}\n", {"GO-CMD-SEC-002"}),
    ("redirect", "Go", "func h(w http.ResponseWriter, r *http.Request) {\n\tu := r.FormValue(\"u\")\n\thttp.Redirect(w, r, u, 302)\n}\n", {"GO-HTTP-SEC-001"}),
    ("path", "Go", "func h(c *gin.Context) {\n\tp := c.Query(\"p\")\n\tb, err := os.ReadFile(p)\n\tuse(b, err)\n}\n", {"GO-FS-SEC-001"}),
    ("gin", "Go", "func h(c *gin.Context, db *gorm.DB) {\n\tvar in T\n\tc.ShouldBindJSON(&in)\n\terr := db.Exec(in).Error\n\tuse(err)\n}\n", {"GIN-SEC-001"}),
    ("ginredirect", "Go", "func h(c *gin.Context) {\n\tu := c.Param(\"u\")\n\tc.Redirect(302, u)\n}\n", {"GIN-SEC-003"}),
    ("gincmd", "Go", "func h(c *gin.Context) {\n\tu := c.Param(\"u\")\n\texec.Command(\"sh\", \"-c\", u).Run()\n}\n", {"GIN-SEC-002"}),
    ("gincmdok", "Go", "func h(c *gin.Context) {\n\tu := c.Param(\"u\")\n\texec.Command(\"ls\", u).Run()\n}\n", set()),
    ("fiber", "Go", "func h(c *fiber.Ctx, db *sql.DB) error {\n\tu := c.Params(\"u\")\n\texec.Command(u).Run()\n\t_, err := db.Exec(u)\n\treturn err\n}\n", {"FIBER-SEC-001", "FIBER-SEC-002"}),
    ("fiberredirect", "Go", "func h(c *fiber.Ctx) error {\n\tu := c.Query(\"u\")\n\treturn c.Redirect(u)\n}\n", {"FIBER-SEC-003"}),
    ("gorm", "Go", "func h(db *gorm.DB, s string) error {\n\treturn db.Raw(\"select \" + s).Error\n}\n", {"GORM-SEC-001"}),
    ("gormopen", "Go", "func h(db *gorm.DB) {\n\ttx := db.Begin()\n\tdb.Session(&gorm.Session{AllowGlobalUpdate: true})\n\tdb.Unscoped().Delete(x)\n}\n", {"GORM-COR-002", "GORM-SEC-002", "GORM-SEC-003", "GORM-COR-001"}),
    ("gormok", "Go", "func h(db *gorm.DB) error {\n\ttx := db.Begin()\n\tdefer tx.Rollback()\n\tres := db.First(x)\n\tif res.Error != nil {\n\t\treturn res.Error\n\t}\n\treturn nil\n}\n", set()),
    ("rows", "Go", "func h(db *sql.DB) {\n\trows, err := db.Query(\"select 1\")\n\tfor rows.Next() {\n\t\tn++\n\t}\n\tlog(err)\n}\n", {"GO-COR-003", "GO-RES-002"}),
    ("rowsok", "Go", "func h(db *sql.DB) error {\n\trows, err := db.Query(\"select 1\")\n\tdefer rows.Close()\n\tfor rows.Next() {\n\t\tn++\n\t}\n\tlog(err)\n\treturn rows.Err()\n}\n", set()),
    ("scan", "Go", "func h(f *os.File) {\n\ts := bufio.NewScanner(f)\n\tfor s.Scan() {\n\t\tif s.Err() != nil {\n\t\t\tn++\n\t\t}\n\t}\n}\n", {"GO-COR-004"}),
    ("tx", "Go", "func h(db *sql.DB) {\n\ttx, err := db.Begin()\n\tlog(err)\n}\n", {"GO-COR-005"}),
    ("open", "Go", "func h(mu sync.Mutex) {\n\tf, err := os.Open(\"x\")\n\tresp, err := http.Get(\"u\")\n\tt := time.NewTicker(1)\n\tctx, cancel := context.WithCancel(nil)\n\tmu.Lock()\n\tlog(err)\n}\n", {"GO-RES-001", "GO-RES-003", "GO-RES-004", "GO-RES-005", "GO-CON-004"}),
    ("openok", "Go", "func h(mu sync.Mutex) (*os.File, error) {\n\tf, err := os.Open(\"x\")\n\tresp, err := http.Get(\"u\")\n\tdefer resp.Body.Close()\n\tt := time.NewTicker(1)\n\tdefer t.Stop()\n\tctx, cancel := context.WithCancel(nil)\n\tdefer cancel()\n\tmu.Lock()\n\tdefer mu.Unlock()\n\treturn f, err\n}\n", set()),
    ("loop", "Go", "func h(items []int, wg sync.WaitGroup) {\n\tfor _, x := range items {\n\t\tgo func() {\n\t\t\twg.Add(1)\n\t\t}()\n\t\tdefer done(x)\n\t\tregexp.MustCompile(\"a\")\n\t}\n}\n", {"GO-CON-001", "GO-CON-002", "GO-CON-003", "GO-PER-001"}),
    ("loopok", "Go", "func h(l Listener) {\n\tfor i := 0; i < 3; i++ {\n\t\tgo work(i)\n\t}\n}\n", set()),
    ("assert", "Go", "func h(v any) {\n\tx := v.(int)\n\tuse(x)\n}\n", {"GO-COR-002"}),
    ("assertok", "Go", "func h(v any) {\n\tx, ok := v.(int)\n\tuse(x, ok)\n}\n", set()),
    ("hash", "Go", "func hashPassword(p []byte) {\n\tx := md5.Sum(p)\n\ty := sha1.Sum(p)\n\tuse(x, y)\n}\n", {"GO-SEC-002", "GO-SEC-003"}),
    ("hashok", "Go", "func sum(p []byte) {\n\tx := md5.Sum(p)\n\tuse(x)\n}\n\nfunc passwordRange(p []byte) {\n\ty := sha1.Sum(p)\n\ta, b := y[:5], y[5:]\n\tuse(a, b)\n}\n", set()),
    ("tls", "Go", "func h() {\n\tc := &tls.Config{InsecureSkipVerify: true}\n\tuse(c)\n}\n", {"GO-SEC-004"}),
    ("mode", "Go", "func h() error {\n\treturn os.Chmod(\"x\", 0o666)\n}\n", {"GO-SEC-005"}),
    ("modeok", "Go", "func h() error {\n\treturn os.Chmod(\"x\", 0o644)\n}\n", set()),
    ("long", "Go", "func h() {\n" + "\tif a && b {\n\t\tc()\n\t}\n" * 40 + "}\n", {"GO-MNT-001", "GO-MNT-002"}),
    ("py", "Python", "import os, sqlite3, pickle, subprocess, requests, torch, cv2\nfrom flask import request\n\ndef h(x=[]):\n    q = request.args.get('q')\n    c = sqlite3.connect('a')\n    k = c.cursor()\n    k.execute('select ' + q)\n    os.system(q)\n    open(q)\n    pickle.loads(q)\n    torch.load(q, weights_only=False)\n    requests.get('u', verify=False)\n    eval(q)\n    exec(q)\n    m = cv2.imread(q)\n    cv2.resize(m, (1, 1))\n    v = cv2.VideoCapture(0)\n", {"PY-SEC-001", "PY-SEC-002", "PY-COR-001", "PY-CMD-SEC-001", "PY-SQL-SEC-001", "PY-FS-SEC-001", "PY-DESER-SEC-001", "PY-ML-SEC-001", "PY-TLS-SEC-001", "PY-CV-COR-001", "PY-CV-RES-001"}),
    ("pyok", "Python", "import os, sqlite3, requests, cv2\nfrom flask import request\n\ndef eval(x):\n    return x\n\ndef h(x=None):\n    q = request.args.get('q')\n    k = sqlite3.connect('a').cursor()\n    k.execute('select ?', (q,))\n    eval(q)\n    exec('1')\n    requests.get(q)\n    m = cv2.imread('a')\n    if m is None:\n        return\n    cv2.resize(m, (1, 1))\n    v = cv2.VideoCapture(0)\n    v.release()\n", set()),
    ("rust", "Rust", "use axum::extract::Query;\nuse sqlx::query;\nuse reqwest::Client;\nuse tokio::time;\n\nasync fn h(Query(p): Query<String>) {\n    let s = format!(\"select {}\", p);\n    sqlx::query(&s);\n    std::fs::read(p);\n    reqwest::get(p);\n    std::process::Command::new(\"sh\").arg(\"-c\").arg(p);\n    std::thread::sleep(d);\n    Client::builder().danger_accept_invalid_certs(true);\n    unsafe { go(); }\n}\n", {"RUST-SQL-SEC-001", "RUST-FS-SEC-001", "RUST-SSRF-SEC-001", "RUST-CMD-SEC-001", "RUST-ASYNC-001", "RUST-TLS-SEC-001", "RUST-COR-001"}),
    ("rustok", "Rust", "use axum::extract::Query;\nuse sqlx::query;\nuse tokio::time;\n\nasync fn h(Query(p): Query<String>) {\n    sqlx::query(\"select ?\").bind(p);\n    tokio::task::spawn_blocking(move || { std::thread::sleep(d); });\n}\n", set()),
    ("cs", "C#", "using System.IO;\nusing System.Diagnostics;\nusing System.Net.Http;\nusing System.Threading.Tasks;\nusing Microsoft.AspNetCore.Mvc;\nusing Microsoft.EntityFrameworkCore;\n\nclass A {\n    public async void H([FromQuery] string id, AppDbContext db) {\n        var q = $\"select {id}\";\n        db.Database.ExecuteSqlRaw(q);\n        File.ReadAllText(id);\n        new HttpClient().GetAsync(id);\n        Process.Start(\"cmd.exe\", \"/c \" + id);\n        Task.Delay(1).Wait();\n        h.ServerCertificateCustomValidationCallback = (a, b, c, d) => true;\n    }\n}\n", {"CSHARP-COR-001", "CSHARP-SEC-001", "CSHARP-FS-SEC-001", "CSHARP-SSRF-SEC-001", "CSHARP-CMD-SEC-001", "CSHARP-ASYNC-001", "CSHARP-TLS-SEC-001"}),
    ("csok", "C#", "using System.IO;\nusing System.Threading.Tasks;\nusing Microsoft.AspNetCore.Mvc;\nusing Microsoft.EntityFrameworkCore;\n\nclass A {\n    public async Task H([FromQuery] string id, AppDbContext db) {\n        db.Database.ExecuteSqlRaw(\"select {0}\", id);\n        File.ReadAllText(\"x\");\n        await Task.Delay(1);\n    }\n    public async void OnClick(object sender, EventArgs e) { await G(); }\n}\n", set()),
]
SUFFIX = {"Go": "go", "Python": "py", "Rust": "rs", "C#": "cs"}


@pytest.fixture(scope="module")
def fired(spark):
    rows = [(i, f"/r/{name}.{SUFFIX[lang]}", lang, (GO if lang == "Go" else "") + body, "one") for i, (name, lang, body, _) in enumerate(CASES)]
    rows += [(900, "/q/handlers/a.go", "Go", 'package a\n\nimport "x/database"\n\nfunc F(r *R) {}\n', "two"), (901, "/q/b.go", "Go", "package b\n\nfunc h() error {\n\treturn os.Chmod(\"x\", 0o666)\n}\n", "two"), (902, "/q/c.go", "Go", None, "two"), (903, "/q/d.go", "Go", "func {", "two"), (904, "/q/e.lua", "Lua", "x", "two")]
    files = spark.createDataFrame(rows, "file_id bigint, path string, language string, content string, repo string")
    facts = semantic_facts(files).join(files.select("file_id", "repo"), "file_id")
    out: dict[str, set[str]] = {}
    found = rules.run(facts).collect()
    for r in found:
        out.setdefault(r.file.rsplit("/", 1)[-1].split(".")[0], set()).add(r.rule_id)
    return out, found


@pytest.mark.parametrize("name", [c[0] for c in CASES])
def test_each_rule_fires_where_it_should_and_nowhere_else(fired, name):
    assert fired[0].get(name, set()) == next(c[3] for c in CASES if c[0] == name)


def test_every_rule_has_a_case():
    assert {r.id for r in rules.RULES} - set().union(*(c[3] for c in CASES)) == {"ARC-001"}
    assert len(rules.register(rules.RULES)) == 63


def test_layers_and_gates_hold_for_each_repository(fired):
    two = [r for r in fired[1] if r.repo == "two"]
    assert [(r.rule_id, r.file) for r in two] == [("ARC-001", "/q/handlers/a.go")]


def test_findings_carry_their_evidence(fired):
    sql = next(r for r in fired[1] if r.rule_id == "GO-SQL-SEC-001")
    assert [s.kind for s in sql.steps] == ["source", "propagation", "sink"] and sql.call_chain[-1] == "db.Exec(q)" and (sql.confidence, sql.strength) == (0.9, "strong")
    inline = next(r for r in fired[1] if r.rule_id == "GO-CMD-SEC-001")
    assert (inline.confidence, [s.kind for s in inline.steps]) == (0.95, ["source", "sink"])
    untraced = next(r for r in fired[1] if r.rule_id == "GORM-SEC-001")
    assert (untraced.severity, untraced.confidence, untraced.strength) == ("Info", 0.5, "heuristic")
    long = next(r for r in fired[1] if r.rule_id == "GO-MNT-001")
    assert long.review_policy == "STATIC_AUTHORITATIVE" and long.severity == "Medium" and "122 lines" in long.title
    assert next(r for r in fired[1] if r.rule_id == "GO-MNT-002").severity == "High"
    assert all(r.observation and r.hypothesis for r in fired[1])


def test_register_refuses_bad_rules():
    one = rules.RULES[0]
    for bad in ([one, one], [None], [rules.Rule("", "a", "b", "fact", "t")], [rules.Rule("X", "a", "b", "nothing", "t")]):
        with pytest.raises(ValueError):
            rules.register(bad)


def test_fact_ids_and_order():
    import hashlib

    assert fact_id("sink", "op", "f", 3, 4) == hashlib.sha256(b"sink\0op\0f\x003\x004").hexdigest()[:24]
    rows, _ = facts_of("Go", "a.go", GO + CASES[0][2])
    assert [(r[7], r[8]) for r in rows] == sorted((r[7], r[8]) for r in rows) and facts_of("Go", "a.go", "func {") is None
