"""Generated, minified, vendored and data files, and hand-written ones that resemble them."""

from quarrymill.llm import layout as L

HAND = "import { A } from './a';\n\nexport function work(a: number): number {\n  if (a > 3) {\n    return a * 2;\n  }\n  // explain\n  const b = call(a, 4);\n  for (const c of b.items) {\n    log(c.name);\n  }\n  return b.size;\n}\n"
GETTERS = "package x;\n" + "".join(f"  public int get{n}() {{ return this.raw[{k}]; }}\n" for k, n in enumerate("ABCDEFGHIJ"))
MINI = "".join(f"function f{k}(a,b){{for(var c=0;c<a.length;c++)b.x(a[c])}}var d=e&&g.h||{k},i=!0;" for k in range(20))
BYTES = "DATA = [" + ",\n  ".join(", ".join(str((k * 37 + j) % 251) for j in range(16)) for k in range(20)) + "]\n"


def kinds(spark, *files):
    df = spark.createDataFrame([(k, t, "source_file", f, r, "any") for k, (t, f, r) in enumerate(files)], "doc_id bigint, text string, source string, file string, root_path string, kinds string")
    got = {r.doc_id: set(r.kinds) for r in L.not_hand_written(df).collect()}
    return [got.get(k, set()) for k in range(len(files))]


def test_kinds(spark):
    p = "/work/a/src/x1.ts"
    r = "/work/a/"
    files = [
        (HAND, p, r),
        (GETTERS, p, r),
        ("// Code generated by tool from a.proto. DO NOT EDIT.\n" + HAND, p, r),
        ("/*\n * NOTE: machine written, see a.tmpl\n */\n" + HAND, p, r),
        (MINI, p, r),
        ("/*! lib 1.2.3 */\n" + MINI, p, r),
        (BYTES, p, r),
        ("const s = \"" + "Ab3/" * 400 + "\";\n", p, r),
        (HAND.replace("work", "lib"), "/work/a/vendor/lib/x.ts", r),
        ("// Copied from lib 1.2.3, upstream revision 40e9c80d01\n" + HAND.replace("work", "other"), p, r),
        (HAND.replace("work", "lib"), "/work/a/src/copy.ts", r),
    ]
    assert kinds(spark, *files) == [set(), {"generated"}, {"generated"}, {"generated"}, {"minified"}, {"minified"}, {"data"}, {"data"}, {"vendored"}, {"vendored"}, {"vendored"}]


def test_hand_written(spark):
    p = "/work/a/src/x1.ts"
    body = "const key = \"" + "Zx9" * 200 + "\";\n"
    files = [
        (HAND + 'out.write("Code generated by tool. DO NOT EDIT.");\n', p, None),
        ("// Do not edit the cache while it is locked\n" + HAND, p, None),
        ("// Generates the weekly report\n" + HAND, "/work/a/tools/generator/x2.ts", "/work/a"),
        ("// see lib.min.js for the bundled build, auto generated nightly\n" + HAND, p, None),
        ("// Wraps the lib 1.2.9 client.\n" + HAND, "/work/a/src/vendor_portal/x3.ts", "/work/a"),
        ("// Copyright the a authors.\n" + HAND, "/work/a/src/vendors/x4.ts", "/work/a"),
        (HAND, "/work/vendor/lib/src/x5.ts", "/work/vendor/lib"),
        (HAND + body, p, None),
        ("import a\n", p, None),
        ("", None, None),
        (None, None, None),
    ]
    assert kinds(spark, *files) == [set()] * len(files)


def test_other_sources_and_empty(spark):
    df = spark.createDataFrame([(1, MINI, "adr", "/a/b", "/a")], "doc_id bigint, text string, source string, file string, root_path string")
    assert L.not_hand_written(df).count() == 0 and L.not_hand_written(df.limit(0)).count() == 0


def judged(text, file="/w/a/src/x.ts", language=None):
    return dict(zip(("generated", "minified", "vendored", "data"), L.judged(text, file, "/w/a", language)[:4]))


def test_short_files_by_evidence():
    short = "function f(a,b){for(var c=0;c<a.length;c++)b.x(a[c])}var d=e&&g.h||3,i=!0;function g(a,b){return a+b*c}var k=l(m,n)?o:p;"
    assert len(short) < 200 and judged(short)["minified"] and judged(short * 4)["minified"]
    assert not any(judged("x=1;\n").values()) and not any(judged("let a=b+c;\n").values())


def test_lexer_states():
    python = 'def f(a):\n    """Code generated by hand.\n\n    x=1;y=2;z=3;\n    """\n    s = "# no comment"  # one\n    return s\n'
    lexed = L.lex(python, "hash")
    assert lexed.code == ["def f(a):", "s = 0", "return s"] and lexed.plain[1] == 's = "# no comment"' and lexed.head == []
    assert L.lex("<!-- Code generated by t. DO NOT EDIT.\n second -->\n<a/>\n", "tags").head == ["<!-- Code generated by t. DO NOT EDIT.", "second -->"]
    assert L.lex("--[[ first\nsecond ]]\nlocal a = '--'\n", "dash").code == ["local a = 0"]
    assert L.lex("let u = 'http://x'; // c\nlet r = /[\"'/]+/g; let t = `a\n// b`;\n", "c").code == ["let u = 0;", "let r =0; let t = 0;"]
    assert L.lex("fn f<'a>(x: &'a str, c: char) { g('\"', \"s\") }\n", "rust").code == ["fn f<'a>(x: &'a str, c: char) { g(0, 0) }"]
    assert L.lex("/* never closed\ncode();\n", "c").code == [] and L.lex("", "c") == L.Lexed([], [], [], 0)
    assert L.family("/a/b.PY", "go") == "hash" and L.family(None, " Ruby ") == "hash" and L.family(None, None) == "c" and L.family("/a/Makefile", "php") == "both"


def test_canonical_layout():
    assert L.canonical(["for(a=0;b<c;d++){e(f,g)}"]) == ["for(a= 0; b< c; d++) { e(f, g)}"]
