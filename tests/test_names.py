"""No function gives a local variable the name of a function of its module that it calls."""

import ast
import glob
import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
MODULES = sorted(os.path.relpath(p, ROOT) for p in glob.glob(f"{ROOT}/tremorlake/**/*.py", recursive=True) + glob.glob(f"{ROOT}/*.py"))


def own_names(scope: ast.AST) -> tuple[set, set]:
    """Names that a function binds and those that it calls, without the functions and lambdas in it."""
    bound, called, todo = set(), set(), list(ast.iter_child_nodes(scope))
    while todo:
        x = todo.pop()
        if isinstance(x, (ast.FunctionDef, ast.Lambda)):
            continue
        if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
            bound.add(x.id)
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Name):
            called.add(x.func.id)
        todo += ast.iter_child_nodes(x)
    return bound, called


@pytest.mark.parametrize("path", MODULES)
def test_locals_hide_no_called_function(path):
    with open(f"{ROOT}/{path}") as file:
        tree = ast.parse(file.read())
    defined = {x.name for x in tree.body if isinstance(x, ast.FunctionDef)} | {a.asname or a.name for x in tree.body if isinstance(x, ast.ImportFrom) for a in x.names}
    for scope in ast.walk(tree):
        if isinstance(scope, ast.FunctionDef):
            bound, called = own_names(scope)
            assert not bound & called & defined, f"{scope.name}: {bound & called & defined}"
