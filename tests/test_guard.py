import random
import re

import pytest

from codemosaic.operators import guard, scanners

CASES = [
    ("guarded average", "pub fn avg(v: &[f64]) -> f64 {\n    if v.is_empty() { return 0.0; }\n    let n = v.len() as f64;\n    if n != 0.0 { total(v) / n } else { 0.0 }\n}", None),
    ("division", "fn share(a: f64, b: f64) -> f64 { a / b }", "DIV_BY_ZERO"),
    ("literal divisor exempts the file", "fn f(a: f64, b: f64) -> f64 { a / b + a / 2.0 }", None),
    ("strict inequality does not exempt", "function f(a, b) { if (b !== 0) { return a / b } }", "DIV_BY_ZERO"),
    ("media type counts as division", 'let kind = "text/html";', "DIV_BY_ZERO"),
    ("index", "fn at(v: &[u8], i: usize) -> u8 { v[i] }", "ARRAY_OOB"),
    ("get exempts", "fn at(v: &[u8], i: usize) -> u8 { v.get(0); v[i] }", None),
    ("length does not exempt", "const x = v.length > i && v[i];", "ARRAY_OOB"),
    ("type subscript counts", "def f(x: List[int]): pass", "ARRAY_OOB"),
    ("unwrap", "fn f(m: Map) -> u8 { m.first().unwrap() }", "UNSAFE_UNWRAP"),
    ("expect", 'fn f(m: Map) -> u8 { m.first().expect("some") }', "UNSAFE_UNWRAP"),
    ("unwrap guarded on its line", "fn f(m: X) -> u8 { if m.is_some() { m.unwrap() } else { 0 } }", None),
    ("unwrap in a comment", "fn f() {\n    // m.unwrap()\n}", None),
    ("unwrap in tests", "fn f() {}\n#[cfg(test)]\nmod t { fn g() { m.unwrap(); } }", None),
    ("mutex and await", "use std::sync::Mutex;\nasync fn f(m: Mutex) { let g = m.lock().unwrap(); tick().await; }", "ASYNC_MUTEX_DEADLOCK"),
    ("other mutex counts too", "use tokio::sync::Mutex;\nasync fn f() { tick().await; }", "ASYNC_MUTEX_DEADLOCK"),
    ("nested quantifier", 'fn f() { let p = "(a+)+$"; }', "REDOS_PATTERN"),
    ("nested quantifier in a comment", '// let p = "(a+)+$";', None),
    ("open", "fn f(a: u8 {", "UNBALANCED_DELIMITERS"),
    ("fragment and void", "const a = <><img src={x}/><div><b>t</b></div></>;", None),
    ("crossed tags", "const a = <div><span></div></span>;", "JSX_TAG_MISMATCH"),
    ("generic counts as tag", "const s = useState<string>(x);", "JSX_TAG_MISMATCH"),
    ("tag in markup comment", "const a = <div><!-- <b> --></div>;", None),
    ("apostrophe opens a string", "const a = <p>don't</p>;", "JSX_TAG_MISMATCH"),
    ("hook in if", "function C(a) {\n  if (a) {\n    useState(0);\n  }\n}", "CONDITIONAL_HOOK_CALL"),
    ("hook in loop", "function C(a) {\n  while (a) {\n    useRef(0);\n  }\n}", "CONDITIONAL_HOOK_CALL"),
    ("hook in ternary", "const v = a ? useMemo(f) : 0;", "CONDITIONAL_HOOK_CALL"),
    ("secret", '"use client"\nconst k = process.env.API_SECRET;', "CLIENT_SECRET_LEAK"),
    ("public name", '"use client"\nconst k = process.env.NEXT_PUBLIC_KEY;', None),
    ("raw html", "const h = <b dangerouslySetInnerHTML={{ __html: body }} />;", "UNSAFE_INNER_HTML"),
    ("sanitized html", "const h = <b dangerouslySetInnerHTML={{ __html: sanitize(body) }} />;", None),
    ("three segments", "export const a = x.y.z;", "NULL_DEREF"),
    ("one optional chain exempts", "export const a = x.y.z + q?.r;", None),
    ("deep access in a comment", "// x.y.z\nexport const a = 1;", None),
    ("windows line ends", "fn f(m: M) -> u8 {\r\n    m.unwrap()\r\n}\r\n", "UNSAFE_UNWRAP"),
    ("multibyte text", "fn é(m: M) { let s = \"ü😀\"; m.unwrap() }", "UNSAFE_UNWRAP"),
    ("nothing", "", None),
]


def test_scenarios(spark):
    df = spark.createDataFrame([(n, c) for n, c, _ in CASES] + [("null", None)], "case string, content string")
    got = {r.case: r for r in guard.verify(df).collect()}
    assert {n: got[n].violation for n, _, _ in CASES} == {n: v for n, _, v in CASES}
    assert all(r.passed == (r.violation is None) == (r.detail is None) for r in got.values()) and got["null"].passed


def test_details_give_bytes(spark):
    code = 'fn é() { let s = "ü"; m.unwrap() }'
    df = spark.createDataFrame([("u", code), ("d", "/* é */ fn f(a: u8, b: u8) { a / b }")], "case string, content string")
    got = {r.case: r.detail for r in guard.verify(df).collect()}
    assert f"byte {code.encode().index(b'.unwrap')}" in got["u"] and f"byte {'/* é */ fn f(a: u8, b: u8) { a / b }'.encode().index(b'a / b')}" in got["d"]


def test_nested_quantifiers_equal_the_stated_pattern():
    stated = re.compile(r"""["'`].*(\(.+[+*]\)[+*]|\([^)]*[+*][^)]*\)[+*]).*["'`]""")
    r = random.Random(1)
    for _ in range(20000):
        text = "".join(r.choice("\"'(((+*))a\n`/") for _ in range(r.randint(3, 16)))
        expected = next(((m.start(), m[0]) for m in stated.finditer(text) if not text[: m.start()].rpartition("\n")[2].lstrip().startswith(("//", "*"))), None)
        assert scanners.first_nested_quantifier(text) == expected, text


def test_nested_quantifiers_are_linear():
    assert scanners.first_nested_quantifier('"' + "(a+" * 20000) is None
    assert scanners.first_nested_quantifier('"' + "(" * 5000 + ")+" * 5000) is None


@pytest.mark.parametrize(("code", "expected"), [("{[()]}", True), ("{[(])}", False), ("(((", False), ('"{" \'}\' `(` r#"["# // {\n /* ( */', True), ("r##\"}\"#\"##", True), ("'ab' {", False), ('"unclosed {', True), ("/*/ { */", True), ("'\\'' {}", True)])
def test_balance(code, expected):
    assert scanners.balanced(code) is expected


def test_histogram(spark):
    df = guard.verify(spark.createDataFrame([(c,) for _, c, _ in CASES], "content string"))
    got = {r.violation: r.n_files for r in guard.violation_histogram(df).collect()}
    assert got["none"] == sum(v is None for _, _, v in CASES) and sum(got.values()) == len(CASES)
