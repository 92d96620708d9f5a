"""Per-file Python source helpers, called inside Arrow batches.

These are the only places where Python source text is parsed. Each function
takes one file's text and returns plain values; Spark does the scanning,
grouping, joining and writing around them. The standard ``ast`` module gives
node positions; edits are applied to the original text so that everything
outside the edited guards (comments, quoting, line endings) stays byte-equal.
"""

from __future__ import annotations

import ast
import bisect
import contextlib
import difflib
import io
import itertools
import keyword
import re
import tokenize
import warnings

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference behaviour).
# Flag names: upper-case words joined by at least one underscore.
FLAG_NAME_PATTERN = r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+"
# Occurrence kinds.
IF_STATEMENT = "if_statement"
TERNARY_EXPRESSION = "ternary_expression"
# ---------------------------------------------------------------------------

_FLAG_RE = re.compile(FLAG_NAME_PATTERN)
_BREAK_RE = re.compile(r"\r\n|\r|\n")
_TRICKY_RE = re.compile(r"[\"'\\#]")
# arms that stand without parentheses wherever the ternary stood in its own
_ATOMIC_ARMS = (ast.Name, ast.Constant, ast.Attribute, ast.Subscript, ast.Call, ast.List, ast.Dict, ast.Set)


@contextlib.contextmanager
def quiet():
    """No warnings about parsed texts; entered once per batch, as it costs a fifth of
    a short file's parse."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        yield


def _parse(text: str) -> ast.Module:
    return compile(text, "<unknown>", "exec", ast.PyCF_ONLY_AST)


_LEAVES = frozenset((ast.Name, ast.Constant, ast.alias, ast.Pass, ast.Break, ast.Continue))


def _walk(tree: ast.AST):
    """``ast.walk`` (the same order) but for nodes without fields; nodes that hold
    neither statements nor expressions are not looked into."""
    nodes = [tree]
    for node in nodes:
        yield node
        if node.__class__ in _LEAVES:
            continue
        values = node.__dict__
        for field in node._fields:
            value = values.get(field)
            if value.__class__ is list:
                nodes += [v for v in value if isinstance(v, ast.AST) and v._fields]
            elif isinstance(value, ast.AST) and value._fields:
                nodes.append(value)


def find_guards(text: str) -> list[tuple[str, str, int, int]]:
    """Return ``(flag_name, kind, line, end_line)`` for every ``if``/``elif``
    statement and conditional expression whose test is a bare flag name.

    Raises ``SyntaxError``/``ValueError`` when the text does not parse.
    """
    tree = _parse(text)
    if text.isascii() and _FLAG_RE.search(text) is None:  # other letters may be a name in another spelling
        return []
    found = []
    for node in _walk(tree):
        if isinstance(node, ast.If):
            kind = IF_STATEMENT
        elif isinstance(node, ast.IfExp):
            kind = TERNARY_EXPRESSION
        else:
            continue
        test = node.test
        if isinstance(test, ast.Name) and _FLAG_RE.fullmatch(test.id):
            found.append((test.id, kind, node.lineno, node.end_lineno))
    return found


class _Doc:
    """Text plus line offsets, counting line breaks the way the compiler does."""

    def __init__(self, text: str):
        self.text = text
        if "\r" in text:
            self.starts = [0] + [m.end() for m in _BREAK_RE.finditer(text)]
        else:
            self.starts = [0, *itertools.accumulate(len(line) + 1 for line in text.split("\n")[:-1])]

    @property
    def newline(self) -> str:
        first = _BREAK_RE.search(self.text)
        return first.group(0) if first else "\n"

    def line_start(self, lineno: int) -> int:
        return self.starts[lineno - 1]

    def line_end(self, lineno: int) -> int:
        """Offset just after the line break of ``lineno`` (or end of text)."""
        return self.starts[lineno] if lineno < len(self.starts) else len(self.text)

    def line(self, lineno: int) -> str:
        return self.text[self.line_start(lineno):self.line_end(lineno)]

    def offset(self, lineno: int, col_bytes: int) -> int:
        start = self.starts[lineno - 1]
        raw = self.text[start:self.line_end(lineno)]
        if raw.isascii():
            return start + col_bytes
        return start + len(raw.encode("utf-8")[:col_bytes].decode("utf-8", "ignore"))

    def start_of(self, node) -> int:
        return self.offset(node.lineno, node.col_offset)

    def end_of(self, node) -> int:
        return self.offset(node.end_lineno, node.end_col_offset)

    def indent(self, lineno: int) -> str:
        raw = self.text[self.line_start(lineno):self.line_end(lineno)]
        return raw[: len(raw) - len(raw.lstrip(" \t\f"))]

    def word(self, pos: int, end: int, word: str) -> int:
        """First place of ``word`` in a stretch of trivia and closing brackets."""
        while pos < end:
            pos = _skip_trivia(self.text, pos, end)
            if self.text.startswith(word, pos):
                return pos
            pos += 1
        raise ValueError(f"no {word!r} where one was expected")


def _skip_trivia(text: str, pos: int, end: int | None = None) -> int:
    """Skip white space, comments and line continuations."""
    end = len(text) if end is None else end
    while pos < end:
        ch = text[pos]
        if ch in " \t\f\r\n\\":
            pos += 1
        elif ch == "#":
            while pos < end and text[pos] not in "\r\n":
                pos += 1
        else:
            break
    return pos


def _back(text: str, pos: int) -> int:
    """The place after the last character before ``pos`` that is no blank."""
    while pos and text[pos - 1] in " \t":
        pos -= 1
    return pos


def _logical_lines(text: str) -> set[int]:
    """Lines on which a statement, a clause or a comment of its own begins. The
    others continue a string or a bracket and keep their leading white space."""
    out, fresh = set(), True
    for tok in tokenize.generate_tokens(io.StringIO(text, newline="").readline):
        if tok.type in (tokenize.INDENT, tokenize.DEDENT):
            continue
        if fresh or tok.type == tokenize.COMMENT and not tok.line[:tok.start[1]].strip():
            out.add(tok.start[0])
        fresh = tok.type == tokenize.NEWLINE or fresh and tok.type in (tokenize.NL, tokenize.COMMENT)
    return out


def _plain_lines(lines: list[str]) -> bool:
    """Whether all of these whole lines, the first of which begins a statement, surely
    begin one: none is blank or holds a quote, a comment or a continuation, and what
    brackets they open they close."""
    for line in lines:
        if _TRICKY_RE.search(line) or not line.strip():
            return False
        if sum(map(line.count, "([{")) != sum(map(line.count, ")]}")):
            return False
    return True


class _Resolver:
    """Edits that resolve all guards of one flag, from a single parse.

    Everything is expressed in offsets of the original text: spans to replace,
    and lines to shift from one indentation to another. Only code that stays is
    walked further, so spans never overlap, however guards are nested.
    """

    def __init__(self, text: str, flag: str, state: bool, tree: ast.Module | None = None):
        self.doc, self.flag, self.state = _Doc(text), flag, state
        self.tree = _parse(text) if tree is None else tree
        self.edits: list[tuple[int, int, str]] = []
        self.shifts: list[tuple[int, int, str, str]] = []
        self.named: list[int] | None = None  # lines that name the flag; None: it may be spelled otherwise
        if text.isascii():
            self.named, at = [], text.find(flag)
            while at >= 0:
                self.named.append(self._line(at))
                at = text.find(flag, at + len(flag)) if flag else -1

    def _names_flag(self, stmt) -> bool:
        """False if no line of the statement, decorators included, names the flag."""
        if self.named is None:
            return True
        first = stmt.decorator_list[0].lineno if getattr(stmt, "decorator_list", None) else stmt.lineno
        i = bisect.bisect_left(self.named, first)
        return i < len(self.named) and self.named[i] <= stmt.end_lineno

    def resolved(self) -> str:
        self._block(self.tree.body, owner_is_module=True)
        if not self.edits:
            return self.doc.text
        if self.shifts:
            logical = None  # of the whole text, if it takes its tokens to tell
            prefix: dict[int, str] = {}
            for first, last, old, new in self.shifts:  # inner blocks come first
                plain = logical is None and _plain_lines([self.doc.line(n) for n in range(first, last + 1)])
                if not plain and logical is None:
                    logical = _logical_lines(self.doc.text)
                for line in range(first, last + 1):
                    if plain or line in logical:
                        now = prefix.get(line, self.doc.indent(line))
                        if now.startswith(old):
                            prefix[line] = new + now[len(old):]
            for line, indent in prefix.items():
                at = self.doc.line_start(line)
                self.edits.append((at, at + len(self.doc.indent(line)), indent))
        out, at = [], 0
        for start, end, new in sorted(self.edits, key=lambda e: (e[0], -e[1])):
            if start < at:  # the indentation of a line that goes as a whole
                continue
            out += [self.doc.text[at:start], new]
            at = end
        return "".join([*out, self.doc.text[at:]])

    def _guard(self, node) -> bool:
        return isinstance(node.test, ast.Name) and node.test.id == self.flag

    def _block(self, stmts: list, owner_is_module: bool = False) -> None:
        """A list of statements; one that loses all of them gets a ``pass``."""
        stmts_here = [s for s in stmts if self._names_flag(s)]
        gone = [s for s in stmts_here if s.__class__ is ast.If and not self._chain(s)]
        for i, s in enumerate(gone):
            if i == 0 and len(gone) == len(stmts) and not owner_is_module:
                new = "pass" + self.doc.newline
                self.edits.append((self.doc.start_of(s), self.doc.line_end(s.end_lineno), new))
            else:
                self.edits.append((self.doc.line_start(s.lineno), self.doc.line_end(s.end_lineno), ""))
        for s in stmts_here:
            if s.__class__ is not ast.If:
                self._inside(s)

    def _inside(self, node) -> None:
        """Statement lists and expressions below any other node."""
        for field in node._fields:
            value = getattr(node, field, None)
            if value.__class__ is list:
                if value and isinstance(value[0], ast.stmt):
                    self._block(value)
                    continue
                children = value
            elif value.__class__ in _LEAVES or not isinstance(value, ast.AST):
                continue
            else:
                children = (value,)
            for child in children:
                if child.__class__ is ast.IfExp and self._guard(child):
                    self._ternary(child)
                elif child.__class__ not in _LEAVES and isinstance(child, ast.AST) and child._fields:
                    self._inside(child)

    def _chain(self, node: ast.If) -> bool:
        """An if with its elif and else branches; False if nothing is left."""
        doc, text = self.doc, self.doc.text
        branches = []  # (test or None, start of the keyword, body)
        at, test, body, orelse = doc.start_of(node), node.test, node.body, node.orelse
        while True:
            branches.append((test, at, body))
            if not orelse:
                break
            only = orelse[0]
            if len(orelse) == 1 and isinstance(only, ast.If) and text.startswith("elif", doc.start_of(only)):
                at, test, body, orelse = doc.start_of(only), only.test, only.body, only.orelse
            else:
                test, at, body, orelse = None, doc.word(doc.end_of(body[-1]), doc.start_of(only), "else"), orelse, []
        ends = [doc.line_start(self._line(b[1])) for b in branches[1:]] + [doc.line_end(node.end_lineno)]
        kept = []
        for i, (test, at, body) in enumerate(branches):
            match = isinstance(test, ast.Name) and test.id == self.flag
            if match and not self.state:
                continue
            kept.append((i, None if match else test, at, body))
            if match:
                break
        if len(kept) == len(branches) and kept[-1][1] is branches[-1][0]:
            for test, _, body in branches:  # no guard in this chain
                if test is not None:
                    self._expression(test)
                self._block(body)
            return True
        if not kept:
            return False
        for test, _, body in [k[1:] for k in kept]:
            if test is not None:
                self._expression(test)
            self._block(body)
        stays = {k[0] for k in kept}
        first, test, at, body = kept[0]
        if first > 0 or test is None:
            if test is None:  # the only branch left: its body takes the place of all
                self._inline(node, first, at, body, ends)
                return True
            self.edits.append((doc.start_of(node), at + 2, ""))  # elif becomes if
        for i, (_, at, _) in enumerate(branches):
            if i > first and i not in stays:
                self.edits.append((doc.line_start(self._line(at)), ends[i], ""))
        last, test, at, body = kept[-1]
        if test is None and branches[last][0] is not None:  # elif FLAG becomes else
            self.edits.append((at, self._colon(branches[last][0]), "else"))
        return True

    def _inline(self, node: ast.If, i: int, at: int, body: list, ends: list[int]) -> None:
        doc = self.doc
        colon = self._line(self._colon(node.test)) if i == 0 else None
        if colon is None:
            test = self._test_of(node, at)
            colon = self._line(self._colon(test) if test is not None else doc.word(at + 4, doc.start_of(body[0]), ":"))
        after = doc.line_end(node.end_lineno)
        if body[0].lineno == colon:  # a one-line suite
            self.edits.append((doc.start_of(node), doc.start_of(body[0]), ""))
        else:
            self.edits.append((doc.line_start(node.lineno), doc.line_start(colon + 1), ""))
            self.shifts.append((colon + 1, self._line(max(0, ends[i] - 1)), doc.indent(body[0].lineno), doc.indent(node.lineno)))
        if ends[i] < after:
            self.edits.append((ends[i], after, ""))

    def _test_of(self, node: ast.If, at: int):
        while self.doc.start_of(node) != at:
            if not (node.orelse and isinstance(node.orelse[0], ast.If)) or self.doc.start_of(node.orelse[0]) > at:
                return None
            node = node.orelse[0]
        return node.test

    def _colon(self, test) -> int:
        return self.doc.word(self.doc.end_of(test), len(self.doc.text), ":")

    def _line(self, offset: int) -> int:
        return bisect.bisect_right(self.doc.starts, offset)

    def _expression(self, node) -> None:
        if isinstance(node, ast.IfExp) and self._guard(node):
            self._ternary(node)
        else:
            self._inside(node)

    def _ternary(self, node: ast.IfExp) -> None:
        doc, text = self.doc, self.doc.text
        start, end = doc.start_of(node), doc.end_of(node)
        arm = node.body if self.state else node.orelse
        if self.state:
            a = start
            b = doc.word(doc.end_of(node.body), doc.start_of(node.test), "if")
            blank = _back(text, b)
            b = blank if text[blank - 1] not in "\r\n\\" and "#" not in text[doc.end_of(node.body):b] else b
        else:
            a = _skip_trivia(text, doc.word(doc.end_of(node.test), doc.start_of(node.orelse), "else") + 4, end)
            b = end
        if start < a:
            self.edits.append((start, a, ""))
        if b < end:
            self.edits.append((b, end, ""))
        # parentheses around the whole go where the arm can stand without them
        left, right = _back(text, start) - 1, _skip_trivia(text, end)
        plain = isinstance(arm, _ATOMIC_ARMS) and arm.lineno == arm.end_lineno and "\n" not in text[a:b]
        if plain and left >= 0 and text[left] == "(" and text[right:right + 1] == ")" and self._grouping(left):
            if not text[start:a].count("#") and not re.match(r"[\w.(\[\"']", text[right + 1:right + 2]):
                self.edits.append((left, start, ""))
                self.edits.append((end, right + 1, ""))
        self._expression(arm)

    def _grouping(self, paren: int) -> bool:
        """Whether the parenthesis neither calls nor touches a word."""
        text, end = self.doc.text, _back(self.doc.text, paren)
        start = end
        while start and (text[start - 1].isalnum() or text[start - 1] == "_"):
            start -= 1
        if start < end:
            return end < paren and keyword.iskeyword(text[start:end])
        return text[end - 1:end] not in (")", "]", "}", '"', "'")


def apply_flag(text: str, flag: str, state: bool, tree: ast.Module | None = None) -> str:
    """Resolve every guard that tests exactly ``flag`` as if it were ``state``."""
    return _Resolver(text, flag, state, tree).resolved()


def _parents(tree: ast.AST) -> dict[int, tuple[ast.AST, list]]:
    """Map id(statement) -> (owner node, the statement list holding it)."""
    out = {}
    for node in _walk(tree):
        for field in ("body", "orelse", "finalbody"):
            seq = getattr(node, field, None)
            for child in seq if isinstance(seq, list) else []:
                out[id(child)] = (node, seq)
    return out


def used_names(tree: ast.AST) -> set[str]:
    """Identifiers used anywhere outside import statements (attribute and
    keyword names included; string contents, including ``__all__``, are not)."""
    names: set[str] = set()
    stack = [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            continue
        if isinstance(node, ast.Name):
            names.add(node.id)
            continue
        if isinstance(node, ast.Attribute):
            names.add(node.attr)
        elif isinstance(node, ast.keyword) and node.arg:
            names.add(node.arg)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            names.add(node.name)
        elif isinstance(node, ast.arg):
            names.add(node.arg)
        elif isinstance(node, (ast.Global, ast.Nonlocal)):
            names.update(node.names)
        elif isinstance(node, ast.ExceptHandler) and node.name:
            names.add(node.name)
        elif isinstance(node, (ast.MatchAs, ast.MatchStar)) and node.name:
            names.add(node.name)
        elif isinstance(node, ast.MatchMapping) and node.rest:
            names.add(node.rest)
        elif isinstance(node, ast.MatchClass):
            names.update(node.kwd_attrs)
        for field in node._fields:
            value = getattr(node, field, None)
            if value.__class__ is list:
                stack += [v for v in value if isinstance(v, ast.AST) and v._fields]
            elif isinstance(value, ast.AST) and value._fields:
                stack.append(value)
    return names


def _binding(alias: ast.alias, from_import: bool) -> str:
    if alias.asname:
        return alias.asname
    return alias.name.split(".")[-1] if from_import else alias.name.split(".")[0]


def clean_imports(text: str, tree: ast.Module | None = None,
                  keep: set[str] | None = None) -> str:
    """Drop import aliases whose bound name is not used outside imports.

    ``from x import *`` and ``from __future__ import ...`` are always kept.
    An import left with no alias is removed; a block left empty gets ``pass``.
    ``tree`` may pass the parse of ``text`` when the caller already has it;
    names in ``keep`` are treated as used.
    """
    if "import" not in text:  # a keyword stands letter by letter
        return text
    tree = _parse(text) if tree is None else tree
    used = used_names(tree) | (keep or set())
    doc = _Doc(text)
    parents = None  # only if an import goes as a whole
    edits: list[tuple[int, int, str]] = []
    removed_by_block: dict[int, list] = {}

    for node in _walk(tree):
        if not isinstance(node, (ast.Import, ast.ImportFrom)):
            continue
        from_import = isinstance(node, ast.ImportFrom)
        if from_import and (node.module == "__future__" or node.names[0].name == "*"):
            continue
        kept = [a for a in node.names if _binding(a, from_import) in used]
        if len(kept) == len(node.names):
            continue
        if kept:
            edits.append(_alias_edit(doc, node, kept))
        else:
            parents = _parents(tree) if parents is None else parents
            owner, seq = parents.get(id(node), (tree, tree.body))
            removed_by_block.setdefault(id(seq), [owner, seq, []])[2].append(node)

    for owner, seq, gone in removed_by_block.values():
        empty_block = len(gone) == len(seq) and not isinstance(owner, ast.Module)
        for i, stmt in enumerate(sorted(gone, key=lambda s: (s.lineno, s.col_offset))):
            edits.append(_removal_edit(doc, stmt, seq, pass_instead=empty_block and i == 0))

    for start, end, new in sorted(edits, key=lambda e: e[0], reverse=True):
        text = text[:start] + new + text[end:]
    return text


def _alias_edit(doc: _Doc, node, kept) -> tuple[int, int, str]:
    text = doc.text
    names = node.names
    parts = []
    for i, alias in enumerate(names):
        if alias not in kept:
            continue
        a_start, a_end = doc.start_of(alias), doc.end_of(alias)
        sep = text[a_end:doc.start_of(names[i + 1])] if i + 1 < len(names) else ""
        parts.append((text[a_start:a_end], sep))
    new = "".join(t + (s if j < len(parts) - 1 else "") for j, (t, s) in enumerate(parts))
    region_end = doc.end_of(names[-1])
    after = _skip_trivia(text, region_end, doc.end_of(node))
    if after < len(text) and text[after] == ",":
        region_end = _skip_trivia(text, after + 1, doc.end_of(node))
    return doc.start_of(names[0]), region_end, new


def _removal_edit(doc: _Doc, stmt, seq, pass_instead: bool) -> tuple[int, int, str]:
    text = doc.text
    others = [s for s in seq if s is not stmt
              and s.lineno <= stmt.end_lineno and s.end_lineno >= stmt.lineno]
    if not others:
        start, end = doc.line_start(stmt.lineno), doc.line_end(stmt.end_lineno)
        new = doc.indent(stmt.lineno) + "pass" + doc.newline if pass_instead else ""
        return start, end, new
    s_start, s_end = doc.start_of(stmt), doc.end_of(stmt)
    later = [s for s in others if s.lineno > stmt.lineno
             or (s.lineno == stmt.lineno and s.col_offset > stmt.col_offset)]
    if later:
        return s_start, doc.start_of(min(later, key=lambda s: (s.lineno, s.col_offset))), ""
    prev = max(others, key=lambda s: (s.end_lineno, s.end_col_offset))
    return doc.end_of(prev), s_end, ""


def rewrite_source(text: str, flag: str, state: bool, scope: str = "all") -> tuple[str, str, str | None]:
    """Resolve ``flag`` in one file: ``(status, updated_text, error)``.

    status is ``mutated``, ``unchanged`` (cleanup skipped, text returned as
    is) or ``failed`` (no partial output). ``scope="all"`` drops every unused
    import of a changed file; ``scope="new"`` only those the change made
    unused (imports that were already unused, e.g. for side effects, stay).
    """
    return rewrite_each(text, [(flag, state)], scope)[0]


def rewrite_each(text: str, asked: list[tuple[str, bool]], scope: str = "all") -> list[tuple[str, str, str | None]]:
    """``rewrite_source`` for several flags of one file, each on the original
    text, which is parsed once for all of them."""
    try:
        tree = _parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return [("failed", None, f"{type(error).__name__}: {error}")] * len(asked)
    return [_rewritten(text, tree, flag, state, scope) for flag, state in asked]


def _rewritten(text: str, before: ast.Module, flag: str, state: bool, scope: str) -> tuple[str, str, str | None]:
    if flag not in text and text.isascii():  # other letters may be a name in another spelling
        return "unchanged", text, None
    try:
        updated = apply_flag(text, flag, state, before)
        if updated == text:
            return "unchanged", text, None
        tree = _parse(updated)  # no partial or broken output
        keep = None
        if scope == "new":
            keep = {_binding(a, isinstance(n, ast.ImportFrom))
                    for n in ast.walk(before) if isinstance(n, (ast.Import, ast.ImportFrom))
                    for a in n.names} - used_names(before)
        cleaned = clean_imports(updated, tree, keep)
        if cleaned != updated:
            _parse(cleaned)  # the edited text must still be Python
        return "mutated", cleaned, None
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return "failed", None, f"{type(error).__name__}: {error}"


def unified_diff_lines(original: str, updated: str, path: str) -> list[str]:
    """Unified diff (3 context lines) of two texts, without line terminators."""
    return list(difflib.unified_diff(
        original.removeprefix("﻿").splitlines(),
        updated.removeprefix("﻿").splitlines(),
        fromfile=f"a/{path}", tofile=f"b/{path}", lineterm=""))
