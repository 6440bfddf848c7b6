"""Scopes against the standard library's symbol tables, and facts of small files."""

import ast
import symtable
import sysconfig
from pathlib import Path

from fathomline.operators import scopes

HARD = '''
import os.path, json as j
from m import thing as t
x = 1
class A:
    x = 2
    y = [x for x in range(3)]
    z = [x + k for k in (1, 2)]
    def f(self, a=x):
        def inner():
            nonlocal a
            return x, a, f
        return inner, A, lambda x=x: (x, a)
    class B:
        w = x
        def g(self):
            global h
            h = x
            try:
                pass
            except ValueError as e:
                return e
            return [(n := v) for v in self if v], n
async def f(*args, **kw):
    match args:
        case [first, *rest]:
            return first, rest, kw
        case {"k": v, **more}:
            return v, more
    with open("a") as fh, fh:
        del fh
    for i in args:
        x: int = i
    return x, undefined
def shadow(f):
    return f(t)
'''


def owners(code):
    """(scope name, line, name) -> owner's (name, line), by the standard library; names declared global or nonlocal left out."""
    out = {}

    def walk(table, stack):
        here = [*stack, table]
        for symbol in table.get_symbols():
            if not symbol.is_referenced() or symbol.is_declared_global() or symbol.is_nonlocal():
                continue
            owner = None
            if table.get_type() == "module" or symbol.is_local():
                owner = table if symbol.is_local() or symbol.is_assigned() or symbol.is_imported() or symbol.is_namespace() else None
            elif symbol.is_free():
                owner = next((t for t in reversed(stack) if t.get_type() == "function" and symbol.get_name() in t.get_identifiers() and t.lookup(symbol.get_name()).is_local()), None)
                if owner is None:  # __class__
                    continue
            else:
                top = here[0]
                name = symbol.get_name()
                owner = top if name in top.get_identifiers() and (top.lookup(name).is_assigned() or top.lookup(name).is_imported() or top.lookup(name).is_namespace()) else None
            out[table.get_name(), table.get_lineno(), symbol.get_name()] = owner and (owner.get_name(), owner.get_lineno())
        for child in table.get_children():
            walk(child, here)

    walk(symtable.symtable(code, "x", "exec"), [])
    return out


def test_owners_are_those_of_the_symbol_tables(spark):
    library = Path(sysconfig.get_paths()["stdlib"])
    files = [("hard.py", HARD), *((f"{n}.py", (library / f"{n}.py").read_text()) for n in ("dataclasses", "enum", "functools", "textwrap", "contextlib"))]
    raw = scopes.rows(spark.createDataFrame(files, "path string, text string"), every_name=True)
    kinds = {(r.path, r.scope): (r.kind, r["name"], r.line_start) for r in raw.filter("item = 'SCOPE'").collect()}
    dynamic = {(r.path, r["name"]) for r in raw.filter("item = 'BIND' AND kind = 'dynamic'").collect()}
    seen = 0
    want = {path: owners(text) for path, text in files}
    for r in scopes.resolved(raw).filter("kind = 'NAME'").collect():
        kind, name, line = kinds[r.path, r.scope]
        if kind == "comprehension" or (r.path, r["name"]) in dynamic:
            continue
        label = lambda k, n: "top" if k == "module" else n.split(".")[-1] if n != scopes.MODULE else "lambda"
        tables = want[r.path]
        at = [(label(kind, name), line or 0, r["name"])] if not (kind == "function" and ("lambda", line, r["name"]) in tables) else [("lambda", line, r["name"]), (label(kind, name), line, r["name"])]
        expected = {tables[k] and tables[k][1] for k in at if k in tables}
        if not expected:
            continue  # decorated functions begin at another line in the tables
        owner = None if r.owner is None else kinds[r.path, r.owner][2] or 0
        assert owner in expected, (r.path, name, line, r["name"], owner, expected)
        seen += 1
    assert seen > 4000


FRAMEWORKS = '''
import flask
from fastapi import FastAPI as Api, APIRouter
from dataclasses import dataclass
import unittest, pytest
import pydantic
app = flask.Flask(__name__)
api: Api = Api()
twice = APIRouter()
twice = APIRouter()
@app.route("/secret", methods=["post", "GET"])
def a(): pass
@app.route("/x", methods=some)
def b(): pass
@api.get("/y")
async def c(): helper(); self.go(); (lambda: helper)()()
@twice.get("/z")
def d(): pass
@app.route
def e(): pass
@dataclass(frozen=True)
class Point: pass
class Model(pydantic.BaseModel, Base): pass
class Case(unittest.TestCase):
    def test_one(self): helper()
class Other(Point, x.Y, make()): pass
@pytest.mark.slow
def slow(): pass
def helper():
    def local(app):
        @app.get("/hidden")
        def inner(): pass
def helper2(helper): helper()
'''


def test_facts_of_frameworks(spark):
    raw = scopes.rows(spark.createDataFrame([("m.py", FRAMEWORKS), ("bad.py", "def ("), ("big.py", "x = 1\n" * 20_000), ("none.py", None), ("skip.txt", "f()")], "path string, text string"))
    assert {(r.path, r.kind) for r in raw.filter("item = 'SKIPPED'").collect()} == {("bad.py", "SYNTAX_ERROR"), ("big.py", "TOO_MANY_NODES")}
    got = {(r.kind, r.source, r.target, r.unresolved) for r in scopes.facts(raw).collect()}
    assert {g for g in got if g[0] == "ROUTE_TO"} == {("ROUTE_TO", "a", None, "route:flask:GET+POST:endpoint-redacted"), ("ROUTE_TO", "b", None, "route:flask:DYNAMIC-METHOD:endpoint-redacted"), ("ROUTE_TO", "c", None, "route:fastapi:GET:endpoint-redacted")}
    assert {g[:2] for g in got if g[0] in ("DATA_MODEL", "TEST")} == {("DATA_MODEL", "Point"), ("DATA_MODEL", "Model"), ("TEST", "Case"), ("TEST", "Case.test_one"), ("TEST", "slow")}
    assert {g[1:] for g in got if g[0] == "EXTENDS"} == {("Model", None, "attribute:BaseModel"), ("Model", None, "name:Base"), ("Case", None, "attribute:TestCase"), ("Other", "Point", None), ("Other", None, "attribute:Y"), ("Other", None, "dynamic-base-expression")}
    assert {("CALL_CANDIDATE", "c", "helper", None), ("CALL_CANDIDATE", "c", None, "attribute:go"), ("CALL_CANDIDATE", "c", None, "dynamic-call-target"), ("CALL_CANDIDATE", "Case.test_one", "helper", None), ("CALL_CANDIDATE", "helper2", None, "name:helper")} <= got
    assert scopes.facts(scopes.rows(spark.createDataFrame([], "path string, text string"))).count() == 0


def test_tables_written_do_not_grow_with_depth_and_short_texts_are_not_walked(spark, monkeypatch):
    """A name is looked for through 60 scopes, one of them a class, with one table of rows and one of uses."""
    written = []
    real = scopes._kept
    monkeypatch.setattr(scopes, "_kept", lambda df: (written.append(1), real(df))[1])
    deep = "def top(): pass\n" + "".join(" " * i + (f"class c{i}:\n" if i == 30 else f"def f{i}():\n") for i in range(60)) + " " * 60 + "top(), f29(), f31(), f40()\n"
    raw = scopes.rows(spark.createDataFrame([(f"{n}.py", deep) for n in range(3)], "path string, text string"))
    got = {(r.path, r.unresolved or r.target.split(".")[-1]) for r in scopes.facts(raw).filter("kind = 'CALL_CANDIDATE'").collect()}
    assert got == {(f"{n}.py", t) for n in range(3) for t in ("top", "f29", "name:f31", "f40")}
    assert len(written) == 2
    dense = ["", "a", "a=b=c", "-~-~a", "a;" * 50, "f'{a:}{b:}'", "a<b<c<d", "[[[[]]]]", "a[:,:,:]", "x:y;z:w", "lambda:0", "import a,b,c", "def f(a,b):0", "{**a,**b}"]
    assert all(sum(1 for _ in ast.walk(ast.parse(t))) <= scopes.NODES_A_CHAR * (len(t) + 4) for t in dense)
