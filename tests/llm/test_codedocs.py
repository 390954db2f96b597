"""Functions and their documentation."""

import time

import pytest

from claimlake.llm import codedocs as C

GO = '''package x

// Part of the tools. Free to use.

// Add adds two numbers and keeps the carry.
//go:noinline
func Add(a int, b int) int {
	s := "func Fake() {"
	return a + b
}

// TODO: document this
func Stub() {}

// Lost comment.

func Bare() {}

// Get returns the stored value or the fallback.
func (s *Store[K]) Get(k string) string { return "" }

var q = `
// Quoted talks about quoting.
func Quoted() {
}
`
'''
PY = '''"""Module text."""

class Base:
    def run(self):
        """Runs the job and returns how many rows it wrote."""

class Child(Base):
    def run(self):
        pass

class Grand(Child):
    def run(self):
        """{@inheritDoc}"""

def f(x,
      y):
    # a note
    r\'\'\'Fold x into y.

    Args:
        x: the first
    \'\'\'
    def inner():
        "Explains the inner step."

def run_fast():
    """Run fast."""

def g():
    z = 1
    """Not a docstring at all."""

s = """
def h():
    \'\'\'Documented but quoted.\'\'\'
"""
'''
RUST = '''/// Loads the table from the given place.
#[inline]
pub(crate) async fn load<T: Into<String>>(p: T) -> bool where T: Clone {
    let c = '{';
}

// Plain comments are no documentation here.
fn plain() {}

trait Shape {
    /// Area in square units.
    fn area(&self) -> f64;
}
struct Sq;
impl Shape for Sq {
    fn area(&self) -> f64 { 1.0 }
}
/* /// Commented out text.
fn gone() {} */
'''
TS = '''/** Sums the values of the list, largest first. */
export const total = async (xs: number[]): Promise<number> => {
  return xs.reduce((a, b) => a + b, 0);
};
/** ---------------------- */
function sep() {}
class A {
  /**
   * Sends the payload once.
   * @param p the payload
   */
  @log()
  static send(p: string): void {
    if (p) { call(p); }
  }
  // Sends again.
  later = function () { return 1; };
}
const t = `
/** Looks documented but is text. */
function no() {}
`;
'''
CS = '''namespace X;
public class Q : P {
    /// <summary>Takes the next item off the queue.</summary>
    [Obsolete("old")]
    internal static bool Take<T>(string a)
    {
        if (a == null) { return Other(a); }
        return true;
    }
    /// <summary>TODO</summary>
    public int Two() => 2;
    // Plain words about three.
    public int Three() { return 3; }
#if false
    /// <summary>Switched off code.</summary>
    public int Four() { return 4; }
#endif
}
'''
CC = '''/* Opens the device and waits for it. */
static inline int open_dev(const char *p) {
    if (p) { go(p); }
    return 0;
}
/** Prototype only. */
int closed(void);
// int gone(int a) {
// }
'''


def documented(content, lang=None, file="a"):
    return {(d.name, d.decl_line) for d in C.scan_file(content, lang, file) if d.has_body and C.substance(d.doc, d.name)}


@pytest.mark.parametrize(
    ("content", "file", "want"),
    [
        (GO, "a.go", {("Add", 7), ("Get", 20)}),
        (PY, "a.py", {("run", 4), ("f", 15), ("inner", 23)}),
        (RUST, "a.rs", {("load", 3)}),
        (TS, "a.ts", {("total", 2), ("send", 13), ("later", 17)}),
        (CS, "a.cs", {("Take", 5)}),
        (CC, "a.c", {("open_dev", 2)}),
    ],
)
def test_languages(content, file, want):
    assert documented(content, None, file) == want
    assert documented("\ufeff" + content.replace("\n", "\r\n"), None, file) == want
    assert documented(content.rstrip("\n"), None, file) == want


@pytest.mark.parametrize("doc", ["", "  ", "----", "TODO", "FIXME: write docs", "N/A", "...", "tbd", "@param x", "{@inheritDoc}", "load_table", "Loads the table.", "The load table function.", "<summary></summary>", "Auto-generated method stub"])
def test_trivial(doc):
    assert not C.substance(doc, "load_table")


@pytest.mark.parametrize("doc", ["Loads rows.", "TODO\nReads the header first.", "@param x the header", "Looks up a key (TODO: measure this)."])
def test_not_trivial(doc):
    assert C.substance(doc, "load_table")


def frame(spark, *rows):
    return spark.createDataFrame(rows, "file_id bigint, repo string, file string, lang string, content string, owner string, name string")


def test_inherited_documentation(spark):
    rows = C.pair_functions(frame(spark, (1, "r", "a.py", None, PY, "clash", "clash"), (2, "r", "b.rs", "rust", RUST, None, None))).collect()
    got = {(r.symbol, r.doc_origin): r.doc for r in rows}
    assert got["Child.run", "inherited"] == got["Grand.run", "inherited"] == got["Base.run", "own"]
    assert got["Sq.area", "inherited"] == "Area in square units."
    assert ("run_fast", "own") not in got
    assert next(r for r in rows if r.symbol == "f").params == ["x"]


def test_nulls_copies_and_empty(spark):
    f = frame(spark, (1, None, None, None, None, None, None), (2, "r", "x.zz", None, "def a(): pass", None, None), (3, "r", "c.go", None, GO, None, None), (4, "r", "c.go", "Go", GO, None, None), (5, "r", "d.go", "go", "", None, None), (None, "r", "e.go", "go", GO, None, None))
    got = C.pair_functions(f)
    assert sorted((r.file_id, r.decl_line) for r in got.collect()) == [(3, 7), (3, 20), (4, 7), (4, 20)]
    assert C.pair_functions(f.limit(0)).isEmpty()


def test_long_file():
    body = "\n\n".join(f"// Step{n} moves item {n} along.\nfunc F{n}() {{}}" for n in range(3000))
    assert len(documented("package x\n\n" + body, "go")) == 3000


def test_large_bundle_is_scanned_in_one_pass():
    one_line = "".join(f"function f{n}(a){{return a+{n};}}" for n in range(30_000))
    lines = "class A {\n" + "\n".join(f"  /** Moves item {n} along. */\n  m{n}(a) {{ return {{ b: a }}; }}" for n in range(8_000)) + "\n}\n"
    python = "class A:\n" + "\n".join(f"    def m{n}(self):\n        return {n}" for n in range(20_000))
    began = time.perf_counter()
    assert len([d for d in C.scan_file(one_line, "js") if d.has_body]) == 30_000
    assert len(documented(lines, "js")) == 8_000
    assert {d.owner for d in C.scan_file(python, "py")} == {"A"}
    assert time.perf_counter() - began < 12


def test_long_signatures():
    many = ",\n".join(f"    argument{n}: &'static Table{n}" for n in range(200))
    where = ",\n".join(f"    T{n}: Clone" for n in range(400))
    assert len(where) > 3_000
    assert documented(f"/// Folds every table into one.\npub fn fold(\n{many}\n) -> Result<(), Error>\nwhere\n{where}\n{{\n}}\n", "rust") == {("fold", 2)}
    inits = ",\n".join(f"  member_{n}(other.member_{n})" for n in range(200))
    assert documented(f"// Copies all members of the other one.\nWide::Wide(const Wide& other)\n : base(other),\n{inits} {{\n}}\n", "c") == {("Wide", 2)}


def inherited(spark, *files):
    rows = C.pair_functions(frame(spark, *[(n, "r", file, None, text, None, None) for n, (file, text) in enumerate(files)])).collect()
    return {(r.file, r.symbol): (r.doc, r.doc_origin) for r in rows}


def test_a_chain_of_seventy_and_a_circle(spark):
    chain = "class C0:\n    def go(self):\n        \"\"\"Goes on to the next station.\"\"\"\n\n" + "\n".join(f"class C{n}(C{n - 1}):\n    {'def go(self): pass' if n == 70 else 'x = 1'}\n" for n in range(1, 71))
    circle = "class A(B):\n    def go(self): pass\n\nclass B(A):\n    def go(self): pass\n"
    got = inherited(spark, ("a.py", chain), ("b.py", circle))
    assert got["a.py", "C70.go"] == ("Goes on to the next station.", "inherited") and not [k for k in got if k[0] == "b.py"]


def test_types_of_one_name_in_two_files(spark):
    base = "class Base:\n    def run(self):\n        \"\"\"Runs {} at night.\"\"\"\n\nclass Child(Base):\n    def run(self): pass\n"
    got = inherited(spark, ("x/a.py", base.format("mail")), ("y/b.py", base.format("pumps")), ("z/c.py", "class Other(Base):\n    def run(self): pass\n"), ("y/d.py", "class Near(Base):\n    def run(self): pass\n"))
    assert got["x/a.py", "Child.run"][0] == "Runs mail at night." and got["y/b.py", "Child.run"][0] == "Runs pumps at night."
    assert got["y/d.py", "Near.run"][0] == "Runs pumps at night." and ("z/c.py", "Other.run") not in got


def test_go_embedding_and_interfaces(spark):
    types = "package p\n\ntype Base struct{}\n\n// Close gives the lock back.\nfunc (b *Base) Close() {}\n\ntype Outer struct {\n\tname string\n\t*Base\n}\n\ntype Walker interface {\n\t// Walk visits every node once.\n\tWalk(n int) error\n\tStop()\n}\n"
    methods = "package p\n\nfunc (o *Outer) Close() {}\n\ntype Tree struct{ n int }\n\nfunc (t Tree) Walk(n int) error { return nil }\nfunc (t Tree) Stop() {}\n\ntype Half struct{}\n\nfunc (h Half) Walk(n int) error { return nil }\n"
    got = inherited(spark, ("p/a.go", types), ("p/b.go", methods), ("q/b.go", methods))
    assert got["p/b.go", "Outer.Close"][0] == "Close gives the lock back." and got["p/b.go", "Tree.Walk"][0] == "Walk visits every node once."
    assert ("p/b.go", "Half.Walk") not in got and not [k for k in got if k[0] == "q/b.go"]


def test_prototypes_in_headers(spark):
    header = "namespace n {\n/** Opens the device and waits for it. */\nint open_dev(const char *p);\nclass Pump {\n public:\n  // Starts the motor slowly at first.\n  void start(int speed);\n};\n}\n"
    source = "int open_dev(const char *p) { return go(p); }\nvoid Pump::start(int speed) { run(speed); }\n"
    got = inherited(spark, ("n.h", header), ("n.cpp", source))
    assert got["n.cpp", "open_dev"] == ("Opens the device and waits for it.", "inherited") and got["n.cpp", "Pump.start"] == ("Starts the motor slowly at first.", "inherited")
    assert ("n.h", "open_dev") not in got


def test_tags_are_followed(spark):
    text = '''class Base {
  /// <summary>Empties the tank by half.</summary>
  public virtual void Drain() { }
}
class Child : Base {
  /// <inheritdoc/>
  /// Also rings the bell twice.
  public override void Drain() { }
}
class Far {
  /// <inheritdoc cref="Base.Drain"/>
  public void Flush() { }
}
'''
    got = inherited(spark, ("a.cs", text))
    assert "Empties the tank by half." in got["a.cs", "Child.Drain"][0] and "rings the bell" in got["a.cs", "Child.Drain"][0]
    assert "Empties the tank" in got["a.cs", "Far.Flush"][0] and got["a.cs", "Far.Flush"][1] == "inherited"
