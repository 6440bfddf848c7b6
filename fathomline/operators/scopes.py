"""Lexical scopes of Python sources as tables, and what calls, base classes, decorators and routes refer to.

One pass over each file gives rows only: scopes with their parents, what each scope binds, and where names are used, with
the scopes that are searched from there: its own and those around it, classes left out unless the use stands in the class
body itself. Which binding a use means is found by joins: it takes the nearest of these scopes that binds its name.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.extraction import MAX_BYTES, MAX_NODES
from fathomline.operators.graph import _kept

ROWS = "path string, item string, scope bigint, kind string, name string, tail string, subject bigint, detail string, line_start bigint, line_end bigint, searched array<bigint>"
#: Rows that a task hands over at once, and nodes of a tree that a character can make at most: texts too short for MAX_NODES are not walked.
BATCH, NODES_A_CHAR = 50_000, 4
# Constructors of applications that routes hang on, bases and decorators that mark a role, methods of routes.
ROUTERS = {"fastapi.FastAPI": "fastapi", "fastapi.APIRouter": "fastapi", "flask.Flask": "flask", "flask.Blueprint": "flask"}
MODEL_BASES = ["pydantic.BaseModel", "sqlalchemy.orm.DeclarativeBase"]
MODEL_DECORATORS = ["dataclasses.dataclass"]
TEST_BASES = ["unittest.TestCase"]
TEST_DECORATORS = "pytest.mark."
METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD"]
# End of fixed values.
MODULE = "<module>"
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _dotted(node: ast.AST) -> tuple[str | None, str]:
    """(first name, the attributes behind it, each with its dot); no name where something else comes first."""
    tail = ""
    while isinstance(node, ast.Attribute):
        node, tail = node.value, f".{node.attr}{tail}"
    return (node.id if isinstance(node, ast.Name) else None), tail


class _Reader(ast.NodeVisitor):
    """Rows of one file. The scope of a comprehension or a lambda has the symbol of the scope around it."""

    def __init__(self, path: str, every_name: bool):
        self.path, self.every_name, self.rows, self.scope, self.kinds, self.parents, self.names, self.searched = path, every_name, [], 0, ["module"], [None], [""], [[0]]
        self.row("SCOPE", "module", MODULE, None, None, 0, None)

    def row(self, item: str, kind: str, name: str | None, tail: str | None, subject: int | None, scope: int | None = None, node: ast.AST | None = None, detail: str | None = None, searched: list[int] | None = None) -> None:
        self.rows.append((self.path, item, self.scope if scope is None else scope, kind, name, tail, subject, detail, getattr(node, "lineno", None), getattr(node, "end_lineno", None), searched))

    def opened(self, kind: str, name: str | None, node: ast.AST) -> int:
        number, outer = len(self.kinds), self.names[self.scope]
        self.kinds.append(kind)
        self.parents.append(self.scope)
        self.names.append(outer if name is None else f"{outer}.{name}".lstrip("."))
        around = self.searched[self.scope]
        self.searched.append([number, *(around[1:] if self.kinds[self.scope] == "class" else around)])
        self.row("SCOPE", kind, self.names[number] or MODULE, None, self.scope, number, node)
        return number

    def inside(self, scope: int, nodes: list[ast.AST]) -> None:
        before, self.scope = self.scope, scope
        for node in nodes:
            self.visit(node)
        self.scope = before

    def bind(self, kind: str, name: str, scope: int | None = None, **more) -> None:
        self.row("BIND", kind, name, more.get("tail"), more.get("subject"), scope, detail=more.get("detail"))

    def use(self, kind: str, expression: ast.AST, node: ast.AST, subject: int | None = None, detail: str | None = None) -> None:
        name, tail = _dotted(expression)
        last = tail.rsplit(".", 1)[-1] if isinstance(expression, ast.Attribute) else None
        self.row("USE", kind, name, tail if name else last and f".{last}", subject, None, node, detail, self.searched[self.scope] if name else None)

    def arguments(self, args: ast.arguments, scope: int) -> None:
        for arg in [*args.posonlyargs, *args.args, *args.kwonlyargs, args.vararg, args.kwarg]:
            if arg is not None:
                self.bind("parameter", arg.arg, scope)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        scope = self.opened("class", node.name, node)
        self.bind("definition", node.name, subject=scope)
        self.decorators(node, scope)
        for base in node.bases:
            self.use("EXTENDS", base, base, scope)
        for part in [*node.bases, *node.keywords]:
            self.visit(part)
        self.inside(scope, node.body)

    def visit_FunctionDef(self, node) -> None:
        scope = self.opened("function", node.name, node)
        self.bind("definition", node.name, subject=scope)
        self.decorators(node, scope)
        args = node.args
        notes = [a.annotation for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, args.vararg, args.kwarg] if a is not None]
        for part in [*args.defaults, *args.kw_defaults, *notes, node.returns]:
            if part is not None:
                self.visit(part)
        self.arguments(args, scope)
        self.inside(scope, node.body)

    visit_AsyncFunctionDef = visit_FunctionDef

    def decorators(self, node, scope: int) -> None:
        for decorator in node.decorator_list:
            called = isinstance(decorator, ast.Call)
            self.use("DECORATOR", decorator.func if called else decorator, decorator, scope, _methods(decorator) if called else None)
            self.visit(decorator)

    def visit_Lambda(self, node: ast.Lambda) -> None:
        for part in [*node.args.defaults, *node.args.kw_defaults]:
            if part is not None:
                self.visit(part)
        scope = self.opened("function", None, node)
        self.arguments(node.args, scope)
        self.inside(scope, [node.body])

    def comprehension(self, node) -> None:
        self.visit(node.generators[0].iter)
        scope = self.opened("comprehension", None, node)
        parts = [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]
        for i, g in enumerate(node.generators):
            self.inside(scope, [g.target, *([g.iter] if i else []), *g.ifs])
        self.inside(scope, parts)

    visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = comprehension

    def visit_NamedExpr(self, node: ast.NamedExpr) -> None:
        scope = self.scope
        while self.kinds[scope] == "comprehension":
            scope = self.parents[scope]
        self.bind("assignment", node.target.id, scope)
        self.visit(node.value)

    def visit_Import(self, node: ast.Import) -> None:
        for alias in node.names:
            self.bind("import", alias.asname or alias.name.split(".")[0], detail=alias.name if alias.asname else alias.name.split(".")[0])

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for alias in node.names:
            if alias.name != "*":
                self.bind("import", alias.asname or alias.name, detail="." * node.level + ".".join(filter(None, (node.module, alias.name))))

    def visit_Assign(self, node) -> None:
        """A name that takes the result of a call keeps what is called."""
        name, tail = _dotted(node.value.func) if isinstance(node.value, ast.Call) else (None, "")
        for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
            if isinstance(target, ast.Name):
                self.bind("assignment", target.id, detail=name, tail=tail)
            else:
                self.visit(target)
        for part in (getattr(node, "annotation", None), node.value):
            if part is not None:
                self.visit(part)

    visit_AnnAssign = visit_Assign

    def visit_Name(self, node: ast.Name) -> None:
        if not isinstance(node.ctx, ast.Load):
            self.bind("assignment", node.id)
        elif self.every_name:
            self.use("NAME", node, node)

    def visit_Call(self, node: ast.Call) -> None:
        self.use("CALL", node.func, node)
        self.generic_visit(node)

    def generic_visit(self, node: ast.AST) -> None:
        if isinstance(node, (ast.Global, ast.Nonlocal)):
            for name in node.names:
                self.bind("dynamic", name)
        elif isinstance(node, (ast.ExceptHandler, ast.MatchAs, ast.MatchStar)) and node.name:
            self.bind("assignment", node.name)
        elif isinstance(node, ast.MatchMapping) and node.rest:
            self.bind("assignment", node.rest)
        super().generic_visit(node)


def _methods(call: ast.Call) -> str:
    """What the decorator's argument ``methods`` lists: GET without one, nothing where it is no list of known methods."""
    given = next((k.value for k in call.keywords if k.arg == "methods"), None)
    if given is None:
        return "GET"
    listed = [e.value.upper() if isinstance(e, ast.Constant) and isinstance(e.value, str) else "" for e in getattr(given, "elts", [])]
    return "+".join(sorted(set(listed))) if listed and set(listed) <= set(METHODS) else ""


def _file_rows(path: str, text: str, every_name: bool) -> list[tuple]:
    skipped = lambda code: [(path, "SKIPPED", None, code, None, None, None, None, None, None, None)]
    if len(text.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        return skipped("SOURCE_TOO_LARGE")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return skipped("SYNTAX_ERROR")
    if NODES_A_CHAR * (len(text) + 4) > MAX_NODES and sum(1 for _ in ast.walk(tree)) > MAX_NODES:
        return skipped("TOO_MANY_NODES")
    reader = _Reader(path, every_name)
    try:
        reader.visit(tree)
    except RecursionError:
        return skipped("TOO_DEEP")
    return reader.rows


def rows(files: DataFrame, every_name: bool = False) -> DataFrame:
    """SCOPE, BIND and USE rows of the Python files among ``files`` (path, text), or one SKIPPED row with a code in ``kind``.

    Uses are CALL, EXTENDS and DECORATOR; with ``every_name`` also every other reading of a name. A null text is empty. The
    rows are written to the shared folder, since all that follows reads them several times.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ROWS.split(", "))])
        batched = lambda held: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
        held: list[tuple] = []
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held += _file_rows(path, text or "", every_name)
                if len(held) >= BATCH:
                    yield batched(held)
                    held = []
        if held:
            yield batched(held)

    return _kept(files.filter(F.col("path").endswith(".py")).select("path", "text").mapInArrow(run, ROWS))


def resolved(raw: DataFrame) -> DataFrame:
    """The uses of ``raw`` with ``owner`` (the scope whose binding they mean; null for none), ``binding`` and ``refers``.

    ``binding`` is null where the owner binds the name more than once; ``refers`` is the scope of the definition or the
    full name of the import. A name that a scope declares global or nonlocal is bound there as ``dynamic``.
    """
    bound = raw.filter("item = 'BIND'").groupBy("path", F.col("scope").alias("outer"), "name").agg(
        F.count("*").alias("times"), F.min(F.struct("kind", "subject", "detail", "tail")).alias("first")
    )
    uses = raw.filter("item = 'USE'").drop("item")
    asked = uses.filter("name IS NOT NULL").select("path", "scope", "name", F.posexplode("searched").alias("steps", "outer"))
    nearest = asked.join(bound, ["path", "outer", "name"]).groupBy("path", "scope", "name").agg(F.min(F.struct("steps", "outer", "times", "first")).alias("n"))
    one = lambda c: F.when(F.col("n.times") == 1, F.col(f"n.first.{c}"))
    found = nearest.select("path", "scope", "name", F.col("n.outer").alias("owner"), one("kind").alias("binding"), one("subject").alias("refers"), one("detail").alias("means"), one("tail").alias("means_tail"))
    return uses.drop("searched").join(found, ["path", "scope", "name"], "left")


def _kept_names(raw: DataFrame) -> DataFrame:
    return raw.filter("item = 'SCOPE'").select("path", "scope", F.col("name").alias("symbol"), F.col("kind").alias("symbol_kind"))


def facts(raw: DataFrame) -> DataFrame:
    """(path, kind, source, target, unresolved, line_start, line_end) of calls, base classes, roles and routes.

    CALL_CANDIDATE and EXTENDS have the target's name where it is a definition of the file (for EXTENDS a class), else
    what is not resolved. DATA_MODEL and TEST are roles of the source; ROUTE_TO has the framework and the method, never the
    endpoint.
    """
    uses, names = _kept(resolved(raw)), _kept_names(raw)
    source = names.select("path", F.col("scope").alias("_s"), F.col("symbol").alias("source"))
    target = names.select("path", F.col("scope").alias("refers"), F.col("symbol").alias("target"), F.col("symbol_kind").alias("target_kind"))
    own = uses.withColumn("_s", F.when(F.col("kind") == "CALL", F.col("scope")).otherwise(F.col("subject")))
    own = own.join(source, ["path", "_s"], "left").join(target, ["path", "refers"], "left")
    canonical = F.when(F.col("binding") == "import", F.concat("means", F.coalesce("tail", F.lit(""))))
    own = own.withColumn("canonical", canonical).withColumn("plain", F.col("name").isNotNull() & (F.coalesce("tail", F.lit("")) == ""))
    missing = F.when(F.col("plain"), F.concat(F.lit("name:"), "name")).when(F.length("tail") > 1, F.concat(F.lit("attribute:"), F.substring_index("tail", ".", -1)))
    fact = lambda df, kind, to, left: df.select("path", kind.alias("kind"), "source", to.alias("target"), left.alias("unresolved"), "line_start", "line_end")
    none = F.lit(None).cast("string")
    defined = F.col("plain") & (F.col("binding") == "definition") & ((F.col("kind") == "CALL") | (F.col("target_kind") == "class"))
    to = F.when(defined, F.col("target"))
    relations = fact(own.filter("kind IN ('CALL', 'EXTENDS')"), F.when(F.col("kind") == "CALL", "CALL_CANDIDATE").otherwise("EXTENDS"), to, F.when(to.isNull(), F.coalesce(missing, F.when(F.col("kind") == "CALL", "dynamic-call-target").otherwise("dynamic-base-expression"))))
    is_class = names.filter("symbol_kind = 'class'").select("path", F.col("scope").alias("_s"))
    base, mark = F.col("kind") == "EXTENDS", F.col("kind") == "DECORATOR"
    model = own.join(is_class, ["path", "_s"], "left_semi").filter(base & F.col("canonical").isin(MODEL_BASES) | mark & F.col("canonical").isin(MODEL_DECORATORS))
    tested = own.filter(base & F.col("canonical").isin(TEST_BASES)).unionByName(own.join(is_class, ["path", "_s"], "left_anti").filter(mark & F.startswith("canonical", F.lit(TEST_DECORATORS))))
    called = raw.filter("item = 'SCOPE' AND kind = 'function' AND startswith(substring_index(name, '.', -1), 'test_')").select("path", F.col("name").alias("source"), "line_start", "line_end")
    first = lambda df, kind: df.groupBy("path", "source").agg(F.min(F.struct("line_start", "line_end")).alias("l")).select("path", F.lit(kind).alias("kind"), "source", none.alias("target"), none.alias("unresolved"), "l.*")
    tests = first(called.unionByName(tested.select("path", "source", "line_start", "line_end")), "TEST")
    return relations.unionByName(first(model, "DATA_MODEL")).unionByName(tests).unionByName(_routes(raw, own))


def _routes(raw: DataFrame, own: DataFrame) -> DataFrame:
    """Routes: a called decorator ``owner.method`` whose owner is bound once, in the module, to a router that an import names."""
    constructed = own.filter("kind = 'DECORATOR' AND owner = 0 AND binding = 'assignment' AND means IS NOT NULL")
    imports = raw.filter("item = 'BIND' AND scope = 0").groupBy("path", F.col("name").alias("means")).agg(F.count("*").alias("times"), F.min(F.struct("kind", "detail")).alias("b")).filter("times = 1 AND b.kind = 'import'")
    frameworks = F.create_map(*(F.lit(x) for pair in ROUTERS.items() for x in pair))
    known = constructed.join(imports, ["path", "means"]).withColumn("framework", F.try_element_at(frameworks, F.concat("b.detail", F.coalesce("means_tail", F.lit("")))))
    verb = F.upper(F.substr("tail", F.lit(2)))
    method = F.when(verb.isin(METHODS), verb).when((F.col("framework") == "flask") & (verb == "ROUTE"), F.when(F.col("detail") == "", "DYNAMIC-METHOD").otherwise(F.col("detail")))
    routes = known.filter("framework IS NOT NULL AND detail IS NOT NULL").withColumn("method", method).filter("method IS NOT NULL")
    return routes.select("path", F.lit("ROUTE_TO").alias("kind"), "source", F.lit(None).cast("string").alias("target"), F.concat(F.lit("route:"), "framework", F.lit(":"), "method", F.lit(":endpoint-redacted")).alias("unresolved"), "line_start", "line_end")
