"""Parsers on a small corpus of our own, one shelter in every language, and a graph built from it."""

import subprocess

import pytest

from loomgraph.parse.registry import default_registry
from loomgraph.session import SourceGraph
from loomgraph.sources import repository

PY = b'''import os
from .base import Thing
# TODO: feed them
class Animal(Thing):
    """A beast."""
    @property
    def label(self):
        return self.speak()
    def speak(self):
        if os.path.exists("x") and True:
            return make()
async def make(n: int = 1) -> int:
    return n
type Alias = int
'''
TS = b"""import { x } from './base';
export interface Shape { a: number }
export class Dog extends Animal {
  // FIXME later
  async bark(n: number): Promise<void> { if (n && this.run()) { helper(n); } }
  run() { return 1; }
}
function helper(n) { return n; }
"""
GO = b"""package shelter
import "fmt"
// Animal is kept.
type Animal struct {
	Base
	Name string
}
type Speaker interface { Speak() string }
// Speak says.
func (a *Animal) Speak() string { if a.Name == "" { return fmt.Sprint("{") }; return helper() }
func helper() string { return "" }
"""
RS = b"""use std::fmt;
/// A beast.
pub struct Animal { name: String }
pub trait Speak { fn speak(&self) -> String; }
impl Speak for Animal { fn speak(&self) -> String { match self.name { _ => self.inner() } } }
impl Animal { pub async fn inner(&self) -> String { String::new() } }
"""
JAVA = b"""import java.util.*;
public abstract class Animal extends Base implements Speaker {
  /** Says. */
  public String speak(int n) { for (;;) { if (n > 1) { return helper(); } } }
  private static String helper() { return ""; }
}
"""
CPP = b"""#include <string>
namespace zoo {
class Animal : public Base { public: std::string speak() const { return helper(1); } };
static int helper(int n) { while (n) { n--; } return n; }
}
"""
CORPUS = {"zoo/animal.py": PY, "zoo/dog.ts": TS, "zoo/animal.go": GO, "zoo/animal.rs": RS, "zoo/Animal.java": JAVA, "zoo/animal.cpp": CPP, "notes.txt": b"# NOTE read\n", "tests/test_a.py": b"def test_a():\n    make()\n", "bad.py": b"def (:\n# BUG here\n"}


@pytest.fixture(scope="module")
def parsed():
    registry = default_registry()
    return {p: registry.parse(p, s) for p, s in CORPUS.items()}


def names(out, kind):
    return {n["qualified_name"] for n in out.nodes if n["kind"] == kind}


@pytest.mark.parametrize(
    ("path", "classes", "functions", "types"),
    [
        ("zoo/animal.py", {"Animal"}, {"Animal.label", "Animal.speak", "make"}, {"Alias"}),
        ("zoo/dog.ts", {"Dog"}, {"Dog.bark", "Dog.run", "helper"}, {"Shape"}),
        ("zoo/animal.go", {"Animal"}, {"Animal.Speak", "helper"}, {"Speaker"}),
        ("zoo/animal.rs", {"Animal"}, {"Animal.speak", "Animal.inner"}, {"Speak"}),
        ("zoo/Animal.java", {"Animal"}, {"Animal.speak", "Animal.helper"}, set()),
        ("zoo/animal.cpp", {"Animal"}, {"Animal.speak", "helper"}, set()),
    ],
)
def test_symbols(parsed, path, classes, functions, types):
    out = parsed[path]
    assert (names(out, "class"), names(out, "function"), names(out, "type")) == (classes, functions, types)
    assert not out.errors


def one(out, name):
    return next(n for n in out.nodes if n.get("qualified_name") == name)


def test_details(parsed):
    py = parsed["zoo/animal.py"]
    assert one(py, "Animal.label")["is_property"] and one(py, "make")["is_async"] and one(py, "Animal")["docstring"] == "A beast."
    assert one(py, "Animal.speak")["complexity"] == 3
    assert {(e["dst"], e["self_call"]) for e in py.edges if e["kind"] == "calls"} == {("func:?::speak", True), ("func:?::make", False)}
    assert [(e["dst"], e.get("module")) for e in py.edges if e["kind"] == "imports"] == [("module:os", None), ("module:.base", ".base")]
    assert [t["kind"] for t in py.todos] == ["TODO"]
    go = parsed["zoo/animal.go"]
    assert one(go, "Animal")["bases"] == ["Base"] and one(go, "Animal.Speak")["docstring"] == "Speak says." and not one(go, "helper")["is_exported"]
    rust = parsed["zoo/animal.rs"]
    assert [e["dst"] for e in rust.edges if e["kind"] == "implements"] == ["type:zoo/animal.rs::Speak"] and one(rust, "Animal.inner")["is_async"]
    java = parsed["zoo/Animal.java"]
    assert one(java, "Animal")["is_abstract"] and one(java, "Animal.helper")["is_staticmethod"] and one(java, "Animal.speak")["complexity"] == 3
    assert {e["self_call"] for e in java.edges if e["kind"] == "calls"} == {True}
    assert not one(parsed["zoo/animal.cpp"], "helper")["is_exported"]


def test_fallbacks(parsed):
    assert parsed["notes.txt"].nodes[0]["lang"] == "txt" and parsed["notes.txt"].todos[0]["text"] == "read"
    assert parsed["bad.py"].errors and parsed["bad.py"].todos[0]["kind"] == "BUG"


def test_graph_from_git(spark, tmp_path):
    for path, source in CORPUS.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(source)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.js").write_text("function no() {}")
    (tmp_path / "big.bin").write_bytes(b"0")
    for args in (("init", "-q"), ("add", "-A"), ("-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", "one")):
        subprocess.run(["git", "-C", str(tmp_path), *args], check=True)
    files = repository.scan(spark, str(tmp_path))
    assert {r.path for r in files.select("path").collect()} == set(CORPUS)
    graph = SourceGraph.build(spark, files, repository.commits(spark, str(tmp_path)))
    assert graph.nodes.where("kind = 'file'").count() == len(CORPUS)
    assert {r.node_id for r in graph.find_callers("func:zoo/animal.py::make").collect()} == {"func:zoo/animal.py::Animal.speak", "func:tests/test_a.py::test_a"}
    assert graph.hot_paths(3).count() == 3 and graph.recent_changes().count() > 0
    graph.save(str(tmp_path / "stored"))
    again = SourceGraph.load(spark, str(tmp_path / "stored"))
    assert again.overview().first() == graph.overview().first()
    assert "# Zoo" in again.context_pack("Zoo", 2000)
    assert repository.changed_files(spark, str(tmp_path), "HEAD", "HEAD").count() == 0
