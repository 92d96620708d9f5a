"""Rewrite and extraction helpers: own examples per behaviour, and generated
programs compared with a plain transformation of their syntax trees."""

import ast
import random
import time

import pytest

from flagtide.functions.pysource import apply_flag, clean_imports, find_guards, rewrite_source

F = "USE_V2"


class Plain(ast.NodeTransformer):
    def __init__(self, state):
        self.state = state

    def visit_If(self, node):
        self.generic_visit(node)
        if isinstance(node.test, ast.Name) and node.test.id == F:
            return node.body if self.state else node.orelse
        node.body = node.body or [ast.Pass()]
        return node

    def visit_IfExp(self, node):
        self.generic_visit(node)
        if isinstance(node.test, ast.Name) and node.test.id == F:
            return node.body if self.state else node.orelse
        return node

    def generic_visit(self, node):
        super().generic_visit(node)
        if not isinstance(node, ast.Module) and getattr(node, "body", None) == []:
            node.body = [ast.Pass()]
        return node


def dump(tree):
    """Statements that do nothing, and ``else`` branches of them, do not count."""
    for node in ast.walk(tree):
        for name in ("body", "orelse", "finalbody"):
            block = getattr(node, name, None)
            if isinstance(block, list) and block and isinstance(block[0], ast.stmt):
                needed = name == "body" and not isinstance(node, ast.Module)
                setattr(node, name, [s for s in block if not isinstance(s, ast.Pass)] or [ast.Pass()] * needed)
    return ast.dump(tree)


def same(source, state):
    got = apply_flag(source, F, state)
    assert dump(ast.parse(got)) == dump(Plain(state).visit(ast.parse(source))), f"{source}\n--- {state}\n{got}"
    return got


SHAPES = [
    "def tax(c):\n    if USE_V2:\n        return c * 2\n    return c\n",
    "for row in rows:\n    if USE_V2:\n        emit(row)\n",
    "if ready:\n    go()\nelif USE_V2:\n    fly()\nelif late:\n    run()\nelse:\n    wait()\n",
    "if USE_V2:\n    a()\nelif USE_V2:\n    b()\nelif c:\n    d()\n",
    "if c:\n    a()\nelif USE_V2:\n    b()\nelif USE_V2:\n    e()\nelse:\n    d()\n",
    "if USE_V2:\n    a()\nelse:\n    if USE_V2:\n        b()\n    else:\n        c()\n",
    "class K:\n    if USE_V2:\n        x = 1\n    if USE_V2:\n        y = 2\n",
    "def f():\n    return(a if USE_V2 else b)\n",
    "x = not(a if USE_V2 else b)\n",
    "x = (a if USE_V2 else b)if c else d\n",
    "x = (1 if USE_V2 else 2).real\n",
    "x = f(a if USE_V2 else b)(c if USE_V2 else d)\n",
    "x = (p or q if USE_V2 else r) and s\n",
    "x = [i for i in (a if USE_V2 else b) if (c if USE_V2 else d)]\n",
    "x = a if USE_V2 else b if USE_V2 else c\n",
    "x = (lambda: 1) if USE_V2 else (lambda: 2)\n",
    "x = (\n    'one '  # kept\n    'two'\n    if USE_V2\n    else other  # gone\n)\n",
    "x = (\n    call(1)\n    .then(2)\n    if USE_V2 else\n    call(3)\n    .then(4)\n)\n",
    "x = f'{(a if USE_V2 else b)!r}'\n",
    "if USE_V2:\n    try:\n        a()\n    except ValueError:\n        b()\n    finally:\n        c()\nelse:\n    pass\n",
    "def f(v):\n    if USE_V2:\n        match v:\n            case [1, *_]:\n                return 1\n            case _:\n                return 2\n    return 3\n",
    "if USE_V2:\n    with a as b, \\\n            c as d:\n        e()\n    s = '''\n  as it is\n'''\n    t = g(\n  1,\n        2)\n",
    "if USE_V2: a(); b()\nelse: c()\n",
    "if (\n    USE_V2\n):\n    a()\nelse:  # why\n    # note\n    b()\n",
    "async def f():\n    async with x:\n        if USE_V2:\n            await y\n        else:\n            z = (await a if USE_V2 else await b)\n",
    "@deco(a if USE_V2 else b)\ndef f(x=c if USE_V2 else d) -> (e if USE_V2 else g): pass\n",
    "while True:\n    if USE_V2:\n\tx()\n    else:\n        break\n".replace("\t", "        "),
    "if a:\n    pass\nelse:\n    if USE_V2:\n        b()\n",
    "é = 'ü' if USE_V2 else 'ö'; n = (é if USE_V2 else 1)\n",
    "if USE_V2:\n\tif x:\n\t\ty()\n",
    "lst = [\n    1,\n    *(a if USE_V2 else b),\n]\n",
    "if x and (USE_V2):\n    a()\nif not USE_V2:\n    b()\nif USE_V2 == 1:\n    c()\n",
]


@pytest.mark.parametrize("source", SHAPES)
@pytest.mark.parametrize("state", [True, False])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_shapes(source, state, newline):
    text = source.replace("\n", newline)
    got = same(text, state)
    assert newline == "\n" or "\n" not in got.replace("\r\n", "")
    status, updated, error = rewrite_source(text, F, state)
    assert status == ("unchanged" if got == text else "mutated") and error is None


def _block(rng, depth, indent):
    out = []
    for _ in range(rng.randint(1, 3)):
        out += _statement(rng, depth, indent)
    return out


def _expression(rng, depth=2):
    if depth and rng.random() < 0.4:
        test = F if rng.random() < 0.6 else "other"
        inner = f"{_expression(rng, depth - 1)} if {test} else {_expression(rng, depth - 1)}"
        return rng.choice(["({})", "g({})", "[{}]", "({}).x", "not({})"]).format(inner)
    return rng.choice(["a", "b.c", "f(1)", "'s'", "(x, y)", "-z", "a or b", "{1: 2}"]) if depth else rng.choice(["a", "(b)"])


def _statement(rng, depth, indent):
    pad = " " * indent
    if not depth or rng.random() < 0.35:
        return [pad + rng.choice([f"v = {_expression(rng)}", f"use({_expression(rng)})", "# a comment\n" + pad + "pass",
                                  "t = '''x\n  y'''", f"w = [\n{pad}      1,\n  {_expression(rng)}]"])]
    kind = rng.choice(["if", "if", "if", "for", "try", "def"])
    step = rng.choice([2, 4])
    if kind == "if":
        out = [f"{pad}if {F if rng.random() < 0.6 else 'cond'}:", *_block(rng, depth - 1, indent + step)]
        for _ in range(rng.randint(0, 2)):
            out += [f"{pad}elif {F if rng.random() < 0.4 else 'cond2'}:", *_block(rng, depth - 1, indent + 3)]
        if rng.random() < 0.5:
            out += [f"{pad}else:", *_block(rng, depth - 1, indent + 4)]
        return out
    if kind == "try":
        return [f"{pad}try:", *_block(rng, depth - 1, indent + step), f"{pad}except E:", *_block(rng, depth - 1, indent + step)]
    head = {"for": "for i in it:", "def": "def fn():"}[kind]
    return [pad + head, *_block(rng, depth - 1, indent + step)]


@pytest.mark.parametrize("seed", range(150))
def test_generated_programs(seed):
    rng = random.Random(seed)
    source = "\n".join(_block(rng, 4, 0)) + "\n"
    for state in (True, False):
        got = same(source, state)
        if F not in source:
            assert got == source


def test_text_outside_guards_is_untouched():
    source = "# head\nx  =  1   # odd spacing\n\n\nif USE_V2:\n    a( 1 )   # kept\nelse:\n    b()\n\ny={ }\n"
    assert apply_flag(source, F, True) == "# head\nx  =  1   # odd spacing\n\n\na( 1 )   # kept\n\ny={ }\n"
    assert apply_flag(source, F, False) == "# head\nx  =  1   # odd spacing\n\n\nb()\n\ny={ }\n"
    assert apply_flag("v = (a if USE_V2 else b)\n", F, True) == "v = a\n"


def test_many_guards_take_linear_time():
    one = "if USE_V2:\n    a{0}()\nelse:\n    b{0}(c if USE_V2 else d)\n"
    source = "".join(one.format(i) for i in range(800))
    started = time.perf_counter()
    status, updated, _ = rewrite_source(source, F, False)
    assert status == "mutated" and updated == "".join(f"b{i}(d)\n" for i in range(800))
    assert time.perf_counter() - started < 1


IMPORTS = [
    ("import json, csv\njson.dumps(1)\n", "import json\njson.dumps(1)\n"),
    ("import xml.dom\nxml.dom.x()\n", None),
    ("import net.http as http\n", ""),
    ("from shop import (\n    cart,\n    till,\n)\ntill()\n", "from shop import (\n    till)\ntill()\n"),
    ("from shop import *\nfrom __future__ import division\n", None),
    ("def g():\n    from shop import cart\n", "def g():\n    pass\n"),
    ("try:\n    import fast\nexcept ImportError:\n    fast = None\n", None),
    ("import a; import b; b.run()\n", "import b; b.run()\n"),
    ("from shop import cart as c, till as t\nprint(t)\n", "from shop import till as t\nprint(t)\n"),
    ("from shop import cart\nx.cart = 1\n", None),
]


@pytest.mark.parametrize("source, cleaned", IMPORTS)
def test_imports(source, cleaned):
    assert clean_imports(source) == (source if cleaned is None else cleaned)


def test_rewrite_drops_what_the_removed_branch_used():
    source = "import audit\nfrom shop import old_till, till\nif USE_V2:\n    till()\nelse:\n    old_till()\n"
    assert rewrite_source(source, F, True)[1] == "from shop import till\ntill()\n"
    assert rewrite_source(source, F, True, scope="new")[1] == "import audit\nfrom shop import till\ntill()\n"


def test_status_and_second_pass():
    assert rewrite_source("v = 1\n", F, True) == ("unchanged", "v = 1\n", None)
    status, updated, error = rewrite_source("else:\n", F, True)
    assert (status, updated) == ("failed", None) and error.startswith("SyntaxError")
    once = rewrite_source(SHAPES[2], F, True)[1]
    assert rewrite_source(once, F, True)[0] == "unchanged"


def test_guards_are_bare_names_in_if_and_ternary():
    source = ("def f():\n    if USE_V2:\n        pass\n    elif SEND_MAIL_2:\n        pass\n"
              "n = [a if USE_V2 else b]\nif use_v2: pass\nif V: pass\nassert USE_V2\nwhile USE_V2: break\n"
              "if USE_V2 or x: pass\nif cfg.USE_V2: pass\nif V2: pass\n")
    assert sorted(find_guards(source)) == [("SEND_MAIL_2", "if_statement", 4, 5), ("USE_V2", "if_statement", 2, 5),
                                          ("USE_V2", "ternary_expression", 6, 6)]
    with pytest.raises(SyntaxError):
        find_guards("if USE_V2\n")


def test_names_in_another_spelling_are_found():
    """Names are compared as the compiler reads them, not as they are written."""
    from flagtide.functions.pysource import find_guards, rewrite_source

    text = "if \uff25N_A:\n    x()\n"
    assert find_guards(text) == [("EN_A", "if_statement", 1, 2)]
    assert rewrite_source(text, "EN_A", True) == ("mutated", "x()\n", None)
    assert rewrite_source("if A:\n    x()\n", "EN_A", True) == ("unchanged", "if A:\n    x()\n", None)
