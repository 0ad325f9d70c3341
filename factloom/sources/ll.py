"""Textual LLVM assembly (typed pointers) as fact tables.

Each file is a module and is parsed whole by one task; files are read through Spark, so they may
be in any store it reads. Value ids of the i-th file start at i * 2^32 and type ids at i * 2^20.
A function's blocks are numbered from 0, its entry.

Read: type definitions, globals, aliases, declarations and definitions with allocas, loads, stores,
address arithmetic, casts, arithmetic, comparisons, calls, invokes, returns, branches, switches,
phis, selects, atomic operations, and constant expressions, each of which is an instruction of
the function that uses it, without a block. Instructions of other kinds keep their opcode, type
unknown, and have no operands. Metadata, attributes and target lines are passed over.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.fixpoint import cut
from .facts import BuildError, MissingTable, Program
from .schema import TABLES


class ParseError(BuildError):
    """A file is not the assembly that this reader knows."""


TOKEN = re.compile(r'c?"(?:[^"\\]|\\.)*"|[%@]"[^"]*"|[%@!][-a-zA-Z$._0-9]+|0x[0-9A-Fa-f]+|-?\d+(?:\.\d+(?:e[+-]?\d+)?)?|\.\.\.|[a-zA-Z_$.][-a-zA-Z0-9_$.]*|[()\[\]{}<>,=*#:!]')
LABEL = re.compile(r'^("[^"]*"|[-a-zA-Z$._0-9]+):')
RESULT = re.compile(r'^\s*(%"[^"]*"|%[-a-zA-Z$._0-9]+)\s*=')

# Words of the language.
SIMPLE = {"void", "label", "metadata", "x86_mmx", "opaque", "half", "float", "double", "fp128", "x86_fp80", "ppc_fp128", "token"}
CASTS = {"bitcast", "inttoptr", "ptrtoint", "trunc", "zext", "sext", "fptrunc", "fpext", "fptoui", "fptosi", "uitofp", "sitofp", "addrspacecast"}
BINARY = {"add", "sub", "mul", "udiv", "sdiv", "urem", "srem", "shl", "lshr", "ashr", "and", "or", "xor", "fadd", "fsub", "fmul", "fdiv", "frem"}
FLAGS = {"inbounds", "nuw", "nsw", "exact", "volatile", "atomic", "tail", "musttail", "notail", "fast", "nnan", "ninf", "nsz", "arcp", "weak", "singlethread"}
CONVENTIONS = {"ccc", "fastcc", "coldcc", "cc", "x86_stdcallcc", "x86_fastcallcc"}
PARAMETER = {"zeroext", "signext", "inreg", "byval", "sret", "noalias", "nocapture", "nonnull", "readonly", "readnone", "nest", "returned", "noundef", "align"}


class _Module:
    def __init__(self, name: str, text: str, number: int):
        self.name, self.next_value, self.next_type = name, number << 32, number << 20
        self.rows: dict[str, list[list]] = {t: [] for t in TABLES}
        self.types: dict[str, int] = {}
        self.shape: dict[int, tuple] = {}  # type id: (kind, elem, n, name, fields)
        self.structs: dict[str, int] = {}
        self.globals: dict[str, tuple[int, int]] = {}  # name: (id, type of the value as an operand)
        self.consts: dict[tuple, tuple[int, int]] = {}
        self.locals: dict[str, int] = {}
        self.local_types: dict[str, int] = {}
        self.blocks: dict[str, int] = {}
        self.fn: int | None = None
        self.lines = [self._bare(x) for x in text.splitlines()]
        self._read()

    # -- ids, tokens -------------------------------------------------------------------------
    @staticmethod
    def _bare(line: str) -> str:
        out, quoted = [], False
        for ch in line:
            quoted ^= ch == '"'
            if ch == ";" and not quoted:
                break
            out.append(ch)
        return "".join(out).rstrip()

    def value_id(self) -> int:
        self.next_value += 1
        return self.next_value

    def load_line(self, text: str) -> None:
        self.toks, self.at, self.line = TOKEN.findall(text), 0, text

    def peek(self, n: int = 0) -> str:
        return self.toks[self.at + n] if self.at + n < len(self.toks) else ""

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if not t or (want is not None and t != want):
            raise ParseError(f"{self.name}: expected {want or 'more'} at {t!r} in: {self.line.strip()}")
        self.at += 1
        return t

    def maybe(self, *words: str) -> str:
        if self.peek() in words and self.peek():
            return self.take()
        return ""

    def skip(self, words: set[str]) -> None:
        while self.peek() in words:
            if self.take() in ("align", "cc"):
                self.take()

    # -- types -------------------------------------------------------------------------------
    def a_type(self, rendered: str, kind: str, elem: int | None = None, n: int | None = None, name: str | None = None, fields: list[int] | None = None) -> int:
        if rendered not in self.types:
            self.next_type += 1
            self.types[rendered] = self.next_type
            self.shape[self.next_type] = (kind, elem, n, name, fields)
        return self.types[rendered]

    def text_of(self, t: int) -> str:
        return next(k for k, v in self.types.items() if v == t)

    def pointer(self, t: int) -> int:
        return self.a_type(self.text_of(t) + "*", "pointer", elem=t)

    def parse_type(self) -> int:
        t = self.take()
        if t in SIMPLE:
            out = self.a_type(t, "float" if t in ("half", "float", "double", "fp128", "x86_fp80", "ppc_fp128") else t)
        elif re.fullmatch(r"i\d+", t):
            out = self.a_type(t, "int", n=int(t[1:]))
        elif t[0] == "%":
            out = self.a_type(t, "struct", name=t[1:].strip('"'))
            self.structs[t] = out
        elif t == "[" or (t == "<" and self.peek() != "{"):
            n = int(self.take())
            self.take("x")
            e = self.parse_type()
            self.take("]" if t == "[" else ">")
            out = self.a_type(f"{t}{n} x {self.text_of(e)}{']' if t == '[' else '>'}", "array" if t == "[" else "vector", elem=e, n=n)
        elif t in ("{", "<"):
            if t == "<":
                self.take("{")
            fs = self.type_list("}")
            if t == "<":
                self.take(">")
            body = "{ " + ", ".join(map(self.text_of, fs)) + " }"
            out = self.a_type(body if t == "{" else f"<{body}>", "struct", fields=fs)
        else:
            raise ParseError(f"{self.name}: no type at {t!r} in: {self.line.strip()}")
        while True:
            if self.maybe("*"):
                out = self.pointer(out)
            elif self.peek() == "(":
                self.take()
                ps = self.type_list(")")
                out = self.a_type(f"{self.text_of(out)} ({', '.join('...' if p < 0 else self.text_of(p) for p in ps)})", "function", elem=out, fields=[p for p in ps if p >= 0])
            else:
                return out

    def type_list(self, end: str) -> list[int]:
        out = []
        while not self.maybe(end):
            if self.maybe("..."):
                out.append(-1)
            else:
                out.append(self.parse_type())
                self.skip(PARAMETER)
            self.maybe(",")
        return out

    def elem(self, t: int) -> int | None:
        return self.shape[t][1]

    def inner(self, t: int, index: int | None) -> int | None:
        kind, elem, _, _, fields = self.shape[t]
        return (fields[index] if fields and index is not None and index < len(fields) else None) if kind == "struct" else elem

    # -- values ------------------------------------------------------------------------------
    def const(self, ckind: str, t: int, key, int_value=None, elements=None, expr=None) -> int:
        at = (ckind, t, key)
        if at not in self.consts:
            self.consts[at] = (self.value_id() if expr is None else expr, t)
            i = self.consts[at][0]
            self.rows["constants"].append([i, ckind, int_value, elements, expr])
            self.rows["values"].append([i, "constant", t, None])
        return self.consts[at][0]

    def parse_value(self, t: int) -> int:
        w = self.take()
        if w[0] == "%":
            if w not in self.locals:
                raise ParseError(f"{self.name}: unknown value {w} in: {self.line.strip()}")
            return self.locals[w]
        if w[0] == "@":
            if w not in self.globals:
                raise ParseError(f"{self.name}: unknown global {w} in: {self.line.strip()}")
            return self.globals[w][0]
        if re.fullmatch(r"-?\d+", w) or w in ("true", "false"):
            n = int(w) if w[-1].isdigit() else int(w == "true")
            return self.const("int", t, n, int_value=n)
        if w in ("null", "undef", "zeroinitializer", "none"):
            return self.const(w, t, w)
        if re.fullmatch(r"-?\d+\.\d+.*|0x[0-9A-Fa-f]+", w) or w.startswith('c"'):
            return self.const("float" if w[0] != "c" else "string", t, w)
        if w in ("{", "[", "<"):
            end, items = {"{": "}", "[": "]", "<": ">"}[w], []
            if w == "<" and self.maybe("{"):
                end = "}"
            while not self.maybe(end):
                items.append(self.parse_value(self.parse_type()))
                self.maybe(",")
            if end == "}" and w == "<":
                self.take(">")
            return self.const({"{": "struct", "[": "array", "<": "vector"}[w], t, tuple(items), elements=items)
        if w == "getelementptr":
            self.skip(FLAGS)
            self.take("(")
            i = self.value_id()
            made = self.address(i, ")")
            return self._expr(i, w, made)
        if w in CASTS:
            self.take("(")
            i = self.value_id()
            a = self.parse_value(self.parse_type())
            self.take("to")
            to = self.parse_type()
            self.take(")")
            self.operand(i, "casted", 0, a)
            return self._expr(i, w, to)
        raise ParseError(f"{self.name}: no value at {w!r} in: {self.line.strip()}")

    def _expr(self, i: int, opcode: str, t: int) -> int:
        self.rows["instructions"].append([i, self.fn, None, None, opcode, t, None, None])
        return self.const("expr", t, i, expr=i)

    def operand(self, i: int, role: str, pos: int, value: int | None, block: int | None = None) -> None:
        self.rows["operands"].append([i, role, pos, value, block])

    def typed(self) -> tuple[int, int]:
        t = self.parse_type()
        self.skip(PARAMETER)
        return t, self.parse_value(t)

    def address(self, i: int, end: str) -> int:
        """Base and indices of an address instruction; the type of its result."""
        t = self.parse_type()
        if self.shape[t][0] != "pointer" or self.peek() == ",":
            self.take(",")  # the pointee's type comes first in newer text
            t = self.parse_type()
        self.operand(i, "base", 0, self.parse_value(t))
        now, n = t, 0
        while self.maybe(","):
            if self.peek()[0] == "!":
                break
            it = self.parse_type()
            v = self.parse_value(it)
            k = next((r[2] for r in self.rows["constants"] if r[0] == v), None)
            self.operand(i, "index", n, v)
            now = self.elem(now) if n == 0 else self.inner(now, k)
            if now is None:
                raise ParseError(f"{self.name}: cannot index in: {self.line.strip()}")
            n += 1
        if end:
            self.take(end)
        return self.pointer(now)

    # -- modules -----------------------------------------------------------------------------
    def _read(self) -> None:
        for x in self.lines:
            if x.startswith("%") and " type " in x:
                self.load_line(x)
                name = self.take()
                self.structs[name] = self.a_type(name, "struct", name=name[1:].strip('"'))
        for x in self.lines:
            if x.startswith("%") and " type " in x:
                self.load_line(x)
                name = self.take()
                self.take("=")
                self.take("type")
                if not self.maybe("opaque"):
                    body = self.parse_type()
                    kind, elem, n, _, fields = self.shape[body]
                    self.shape[self.structs[name]] = (kind, elem, n, name[1:].strip('"'), fields)
        self._declare()
        self._initialise()
        body: list[str] | None = None
        for x in self.lines:
            if x.startswith("define"):
                body = [x]
            elif body is not None and x == "}":
                self._function(body)
                body = None
            elif body is not None:
                body.append(x)
        if body is not None:
            raise ParseError(f"{self.name}: a function does not end")
        for rendered, i in self.types.items():
            kind, elem, n, name, fields = self.shape[i]
            self.rows["types"].append([i, kind, elem, n, name, fields, rendered])

    def _head(self, x: str) -> tuple[str, int, list[tuple[int, str]]]:
        """(name, type, parameters) of a define or declare line."""
        self.load_line(x)
        while not (self.peek()[0] in "%[{<" or re.fullmatch(r"i\d+", self.peek()) or self.peek() in SIMPLE):
            self.take()
        # The result type ends before the name; a parameter list is not a part of it.
        ret = self.parse_type()
        name = self.take()
        self.take("(")
        params, var = [], False
        while not self.maybe(")"):
            if self.maybe("..."):
                var = True
            else:
                t = self.parse_type()
                self.skip(PARAMETER)
                params.append((t, self.take() if self.peek().startswith("%") else ""))
            self.maybe(",")
        rendered = ", ".join([self.text_of(t) for t, _ in params] + ["..."] * var)
        return name, self.a_type(f"{self.text_of(ret)} ({rendered})", "function", elem=ret, fields=[t for t, _ in params]), params

    def _declare(self) -> None:
        for x in self.lines:
            if x.startswith(("define", "declare")):
                name, t, _ = self._head(x)
                if name not in self.globals:
                    self.globals[name] = (self.value_id(), self.pointer(t))
                    self.rows["functions"].append([self.name, self.globals[name][0], name[1:].strip('"'), x.startswith("declare"), t])
            elif x.startswith("@"):
                self.globals[TOKEN.match(x).group()] = (self.value_id(), 0)

    def _initialise(self) -> None:
        for x in self.lines:
            if not x.startswith("@"):
                continue
            self.load_line(x)
            name = self.take()
            self.take("=")
            words = []
            while not (self.peek()[:1] in ("%", "[", "{", "<") or re.fullmatch(r"i\d+", self.peek()) or self.peek() in SIMPLE):
                words.append(self.take())
                if self.peek() == "(":
                    while self.take() != ")":
                        pass
            t = self.parse_type()
            i = self.globals[name][0]
            if "alias" in words:
                if self.maybe(","):  # the value's type comes first in newer text
                    t = self.parse_type()
                self.globals[name] = (i, t)
                self.rows["globals"].append([i, name[1:].strip('"'), "alias", t, self.parse_value(t)])
                continue
            external = "external" in words or "extern_weak" in words
            has = self.peek() not in ("", ",")
            self.globals[name] = (i, self.pointer(t))
            self.rows["globals"].append([i, name[1:].strip('"'), "external" if external else "global", self.pointer(t), self.parse_value(t) if has else None])

    def _function(self, body: list[str]) -> None:
        name, _, params = self._head(body[0])
        self.fn, self.locals, self.local_types, self.blocks = self.globals[name][0], {}, {}, {}
        self.consts = {k: v for k, v in self.consts.items() if k[0] != "expr"}
        for pos, (t, p) in enumerate(params):
            i = self.value_id()
            p = p or f"%{pos}"
            self.locals[p] = i
            self.rows["arguments"].append([self.fn, pos, i, p[1:].strip('"'), t])
        # One instruction a line, but for switches, whose cases may take several.
        lines, open_ = [], ""
        for x in body[1:]:
            open_ = f"{open_} {x.strip()}" if open_ else x
            if open_.count("[") > open_.count("]"):
                continue
            lines.append(open_)
            open_ = ""
        parts: list[tuple[str, list[tuple[int, str, str]]]] = []
        for x in lines:
            m = LABEL.match(x)
            if m:
                parts.append((m.group(1).strip('"'), []))
                x = x[m.end() :]
            if not x.strip():
                continue
            if not parts:
                parts.append((str(len(params)) if all(not p for _, p in params) else "", []))
            r = RESULT.match(x)
            i = self.value_id()
            if r:
                self.locals[r.group(1)] = i
            parts[-1][1].append((i, r.group(1)[1:].strip('"') if r else None, x[r.end() :] if r else x))
        for n, (label, _) in enumerate(parts):
            self.blocks["%" + label] = n
            self.rows["blocks"].append([self.fn, n, n, label])
        for n, (_, items) in enumerate(parts):
            for ord_, (i, result, x) in enumerate(items):
                self.load_line(x)
                opcode, t, pred = self.instruction(i)
                self.rows["instructions"].append([i, self.fn, n, ord_, opcode, t, result, pred])
        self.fn = None

    def label(self) -> int:
        self.take("label")
        b = self.take()
        b = "%" + b[2:-1] if b.startswith('%"') else b
        if b not in self.blocks:
            # The entry may go without a label: its number is then the one that nothing else has.
            first = next((k for k, v in self.blocks.items() if v == 0), None)
            if first in ("%", None):
                return 0
            raise ParseError(f"{self.name}: unknown block {b} in: {self.line.strip()}")
        return self.blocks[b]

    def instruction(self, i: int) -> tuple[str, int | None, str | None]:
        """(opcode, type, predicate); operands go to their table."""
        self.skip(FLAGS)
        op = self.take()
        self.skip(FLAGS)
        put: Callable[..., None] = lambda role, value, pos=0, block=None: self.operand(i, role, pos, value, block)
        if op == "alloca":
            return op, self.pointer(self.parse_type()), None
        if op == "load":
            t = self.parse_type()
            if self.maybe(","):
                p = self.parse_type()
            else:
                p, t = t, self.elem(t)
            put("address", self.parse_value(p))
            return op, t, None
        if op == "store":
            put("value", self.typed()[1])
            self.take(",")
            put("address", self.typed()[1])
            return op, None, None
        if op == "getelementptr":
            return op, self.address(i, ""), None
        if op in CASTS:
            put("casted", self.typed()[1])
            self.take("to")
            return op, self.parse_type(), None
        if op in BINARY:
            t, a = self.typed()
            self.take(",")
            put("lhs", a)
            put("rhs", self.parse_value(t))
            return op, t, None
        if op in ("icmp", "fcmp"):
            pred = self.take()
            t, a = self.typed()
            self.take(",")
            put("cmp1", a)
            put("cmp2", self.parse_value(t))
            return op, self.a_type("i1", "int", n=1), pred
        if op in ("call", "invoke"):
            return self.call(i, op)
        if op == "ret":
            if not self.maybe("void"):
                put("retval", self.typed()[1])
            return op, None, None
        if op == "br":
            if self.peek() == "label":
                put("dest", None, 0, self.label())
            else:
                put("cond", self.typed()[1])
                for role in ("true_bb", "false_bb"):
                    self.take(",")
                    put(role, None, 0, self.label())
            return op, None, None
        if op in ("switch", "indirectbr"):
            put("cond", self.typed()[1])
            self.take(",")
            if op == "switch":
                put("default_bb", None, 0, self.label())
            self.take("[")
            n = 0
            while not self.maybe("]"):
                if op == "switch":
                    v = self.typed()[1]
                    self.take(",")
                    put("case", v, n, self.label())
                else:
                    put("target", None, n, self.label())
                    self.maybe(",")
                n += 1
            return op, None, None
        if op == "phi":
            t, n = self.parse_type(), 0
            while self.maybe("["):
                v = self.parse_value(t)
                self.take(",")
                b = self.take()
                put("incoming", v, n, self.blocks.get("%" + b[2:-1] if b.startswith('%"') else b, 0))
                self.take("]")
                self.maybe(",")
                n += 1
            return op, t, None
        if op == "select":
            put("cond", self.typed()[1])
            t = None
            for n in range(2):
                self.take(",")
                t, v = self.typed()
                put("incoming", v, n)
            return op, t, None
        if op == "atomicrmw":
            pred = self.take()
            put("pointer", self.typed()[1])
            self.take(",")
            t, v = self.typed()
            put("value", v)
            return op, t, pred
        if op == "cmpxchg":
            put("pointer", self.typed()[1])
            self.take(",")
            put("cmp1", self.typed()[1])
            self.take(",")
            t, v = self.typed()
            put("value", v)
            return op, t, None
        if op == "resume":
            put("value", self.typed()[1])
            return op, None, None
        return op, None, None

    def call(self, i: int, op: str) -> tuple[str, int | None, None]:
        self.skip(FLAGS | CONVENTIONS | PARAMETER)
        t = self.parse_type()
        if self.shape[t][0] == "pointer" and self.shape[self.elem(t)][0] == "function" and self.peek()[:1] in "%@" and self.peek():
            t = self.elem(self.elem(t))
        elif self.shape[t][0] == "function":
            t = self.elem(t)
        self.operand(i, "callee", 0, self.parse_value(t))
        self.take("(")
        n = 0
        while not self.maybe(")"):
            if self.peek() == "metadata":
                while self.peek() not in (",", ")"):
                    self.take()
            else:
                self.operand(i, "arg", n, self.typed()[1])
            n += 1
            self.maybe(",")
        if op == "invoke":
            while self.peek() != "to":
                self.take()
            self.take("to")
            self.operand(i, "normal_bb", 0, None, self.label())
            self.take("unwind")
            self.operand(i, "unwind_bb", 0, None, self.label())
        return op, t, None


def parse(name: str, text: str, number: int = 0) -> dict[str, list[list]]:
    """The rows of each fact table of one module's text."""
    return _Module(name, text, number).rows


def program_from_text(spark: SparkSession, text: str, name: str = "m") -> Program:
    """A program from one module's text, as from a handle or a buffer."""
    return Program.from_rows(spark, **{t: [tuple(r) for r in rows] for t, rows in parse(name, text).items()})


def program_from_files(spark: SparkSession, path: str, pattern: str | None = None) -> Program:
    """The modules of all files under ``path``, or of those whose names match ``pattern``."""
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    files = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    # One name for each file meets on the driver; texts stay with the tasks.
    number = {r["path"]: i for i, r in enumerate(files.select("path").orderBy("path").collect())}
    if not number:
        raise MissingTable(f"no files under {path}")

    def run(batches) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for p, text in zip(pdf["path"], pdf["value"], strict=True):
                for t, rows in parse(p, text, number[p]).items():
                    cols = [c.split()[0] for c in re.split(r", (?=\w+ )", TABLES[t])]
                    out += [(t, json.dumps(dict(zip(cols, r, strict=True)))) for r in rows]
            yield pd.DataFrame(out, columns=["t", "row"])

    parsed = cut(files.mapInPandas(run, "t string, row string"))
    return Program(spark, {t: parsed.where(F.col("t") == t).select(F.from_json("row", s).alias("x")).select("x.*") for t, s in TABLES.items()})
