"""Facts read from small source texts."""

import pytest

from quarrymill.functions import rules as R
from quarrymill.operators import facts

DOC = "doc_id bigint, source string, root_path string, file string, text string, lang string, name string"


def files(spark, *rows):
    df = spark.createDataFrame([(k, "source_file", "/w", f"/w/{f}", t, "clash", "clash") for k, (f, t) in enumerate(rows)] + [(99, "adr", "/w", "/w/a.py", "def no(): pass", None, None)], DOC)
    return facts.source_files(df)


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_symbols_of_each_language(spark):
    f = files(
        spark, ("a.py", "import os.path\nclass K(B):\n    def run(self):\n        raise X(go(1))\n"), ("a.rb", "require 'x/y'\nmodule M\ndef self.run(a)\n"), ("a.go", 'import "x/y"\ntype T struct {}\nfunc (t *T) Run(a int) error {\n'),
        ("a.rs", "use a::b;\nstruct S;\npub fn run(a: u8) {}\n"), ("a.kt", "import a.B\nclass C\nfun run() {}\n"), ("a.php", "<?php\nuse A\\B;\nclass C {}\nfunction run() {}\n"), ("a.js", "const x = require('./y');\nclass C {}\nfunction run() {}\n"),
        ("a.ts", "import { A } from '../y';\ninterface I {}\nexport function run() {}\n"), ("a.java", "import a.B;\nclass C {}\npublic static List<X> run(int a) {\n"), ("a.cs", "using A.B;\nclass C {}\ninternal Foo run(int a) {\n"), ("a.cpp", '#include "y.h"\nclass C {};\nint run(int a) {\n'),
        ("a.txt", "def run(): pass"), ("b.py", None), ("c.py", ""),
    )
    got = rows(facts.symbols(f, "function", "class", "import"), "doc_id", "kind", "name")
    for k in range(11):
        assert sorted({kind for d, kind, _ in got if d == k}) == ["class", "function", "import"], k
        assert (k, "function", "Run" if k == 2 else "run") in got
    assert {d for d, _, _ in got} == set(range(11))
    assert {(r.doc_id, r.functions) for r in facts.parsed(f, ["function"]).where("doc_id IN (0, 11, 13)").collect()} == {(0, 1), (11, 0), (13, 0)}


@pytest.mark.parametrize("file,text,rule,method,path", [
    ("a.js", "app.get('/x', f)", "express", "get", "/x"), ("a.js", 'fastify.post("/x", f)', "fastify", "post", "/x"), ("a.ts", "@Put('x')", "nestjs", "Put", "x"), ("a.ts", "export async function GET(r) {", "nextjs", "GET", "("),
    ("a.ts", "a: t.query(() => 1)", "trpc", "query", "(("), ("a.ts", "fetch('/x')", "frontend", "fetch", "/x"), ("a.py", "@app.route('/x')", "flask", "route", "/x"), ("a.py", "[path('x/', v)]", "django", "path", "x/"),
    ("a.java", '@GetMapping("/x")', "spring", "Get", "/x"), ("a.cs", '[HttpDelete("x")]', "aspnet", "Delete", "x"), ("a.go", 'r.GET("/x", f)', "gin", "GET", "/x"), ("a.rs", '#[post("/x")]', "actix", "post", "/x"),
    ("a.php", "Route::get('/x', f)", "laravel", "get", "/x"), ("a.rb", "  get '/x', to: y", "rails", "get", "/x"),
])
def test_endpoints(spark, file, text, rule, method, path):
    assert (rule, method, path) in rows(facts.extracted(files(spark, (file, text)), R.ENDPOINTS, "method", "path"), "rule", "method", "path")


def test_models_packs_and_genes(spark):
    f = files(
        spark, ("a.rb", "class U < ApplicationRecord"), ("a.py", "class D(models.Model):\nclass S(Base):"), ("a.cs", "DbSet<E> x;"), ("a.java", "@Entity\npublic class H {"), ("a.php", "class L extends Model {"),
        ("a.ts", "mongoose.model('M', s); prisma.p.find(); sequelize.define('Q', {}); @Entity() export class T {}"), ("b.py", "login('x')\ndescribe('y')"), ("c.py", "login('x')"),
    )
    assert rows(facts.extracted(f, R.MODELS, "model"), "rule", "model") == sorted([("active_record", "U"), ("django", "D"), ("sqlalchemy", "S"), ("ef_core", "E"), ("hibernate", "H"), ("eloquent", "L"), ("mongoose", "M"), ("prisma", "p"), ("sequelize", "Q"), ("typeorm", "T")])
    packs = {(r.doc_id, r.pack) for r in facts.pack_matches(f, R.load_packs()).collect()}
    assert (7, "auth") in packs and (6, "auth") not in packs and (1, "django") in packs
    with pytest.raises(ValueError):
        R.load_packs("a = { none = ['x'] }")
    health = facts.gene_health(spark.createDataFrame([("g", "a", 3), ("g", "b", 1), ("h", "a", 2)], "gene string, allele string, files bigint"))
    assert [(r.gene, r.dominant, r.consistency) for r in health.orderBy("gene").collect()] == [("g", "a", 0.75), ("h", "a", 1.0)]


def test_calls_resolve_in_order(spark):
    f = files(
        spark, ("p/a.py", "from q.b import far\ndef near(): pass\nnear()\nfar()\nbeside()\nonce()\nother()\nget_it()\nnobody()\n"), ("q/b.py", "def far(): pass\n"), ("q/c.py", "def far(): pass\n"), ("p/d.py", "def beside(): pass\n"),
        ("q/e.py", "def once(): pass\n"), ("q/f.js", "function once() {}\nfunction other() {}\nfunction getIt() {}\n"), ("q/g.py", "def beside(): pass\n"),
    )
    got = {r.callee: (r.strategy, r.target) for r in facts.resolved_calls(f).where("doc_id = 0").collect()}
    assert got == {"near": ("same_file", 0), "far": ("imported", 1), "beside": ("same_folder", 3), "once": ("language", 4), "other": ("unique", 5), "get_it": ("fuzzy", 5), "nobody": ("unresolved", None)}
    assert rows(facts.import_edges(f), "src", "dst") == [(0, 1)]


def test_asyncapi(spark):
    from quarrymill.sources import readers

    text = '{"channels": {"a/b": {"publish": {"message": {"name": "M"}}, "subscribe": {"message": {"name": "N"}}}, "c": {"subscribe": {}}}}'
    specs = spark.createDataFrame([(1, text), (2, "{"), (3, None)], "id int, t string")
    assert rows(readers.asyncapi_operations(specs, "id", "t"), "id", "channel", "operation") == [(1, "a/b", "publish"), (1, "a/b", "subscribe"), (1, "c", "subscribe")]


def test_contracts(spark):
    from quarrymill.operators import matching

    field = "id int, field string, kind string"
    pairs = spark.createDataFrame([(1, 7, 1.0)], "b int, f int, score double")
    b, f = spark.createDataFrame([(1, "a", "int"), (1, "b", "string"), (2, "z", "int")], field), spark.createDataFrame([(7, "a", "string"), (7, "c", "int")], field)
    assert rows(matching.field_mismatches(pairs, b, f), "field", "problem") == [("a", "kind"), ("b", "unused"), ("c", "missing")]
    version = "method string, path string, fields array<string>"
    old = spark.createDataFrame([("get", "/u/:id", ["a", "b"]), ("post", "/u", ["a"]), ("get", "/gone", [])], version)
    new = spark.createDataFrame([("GET", "/u/{user}", ["a"]), ("POST", "/u/", ["a", "c"]), ("GET", "/new", [])], version)
    got = rows(matching.endpoint_changes(old, new), "method", "path", "change", "breaking")
    assert got == [("GET", "/gone", "removed", True), ("GET", "/new", "added", False), ("GET", "/u/:x", "fields_lost", True), ("POST", "/u", "fields_added", False)]
