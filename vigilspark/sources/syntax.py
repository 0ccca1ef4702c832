"""An error-tolerant lexer and bracket matcher that gives the nodes on which rules are written, for four languages.

Nothing fails on broken code: brackets without a partner end where the text ends. A node is a row of NODE; positions are 1-based, columns count bytes.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

ARG = "struct<kind:string,text:string,op:string,name:string,callee_kind:string,left_kind:string,left_text:string>"
NODE = f"kind string, name string, recv string, callee_kind string, path array<string>, recv_path array<string>, args array<{ARG}>, args_text string, lhs string, lhs_kind string, rhs string, rhs_kind string, op string, text string, before string, start_line int, start_column int, end_line int, end_column int"
NAMES = "kind name recv callee_kind path recv_path args args_text lhs lhs_kind rhs rhs_kind op text before start_line start_column end_line end_column".split()

_STRING = {
    "rust": r'r#*"(?:.|\n)*?"#*|b?"(?:\\.|[^"\\])*"|b?\'(?:\\.|[^\'\\\n])\'',
    "python": r'[rRbBfFuU]{0,2}(?:"""(?:\\.|[^\\])*?"""|\'\'\'(?:\\.|[^\\])*?\'\'\'|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')',
    "javascript": r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "go": r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
}
_COMMENT = {"python": r"#[^\n]*"}
_LEXERS = {
    k: re.compile(
        rf"(?P<comment>{_COMMENT.get(k, r'//[^\n]*|/\*(?:.|\n)*?\*/')})|(?P<str>{_STRING[k]})|(?P<tmpl>`(?:\\.|[^`\\])*`)|(?P<life>'[A-Za-z_]\w*)|(?P<ident>[A-Za-z_$]\w*)|(?P<num>\d[\w.]*)"
        r"|(?P<nl>\n)|(?P<space>[ \t\r]+)|(?P<punct>::|:=|=>|->|\?\.|===|!==|==|!=|<=|>=|&&|\|\||\+=|-=|\*\*|<-|\.\.\.|.)",
        re.S,
    )
    for k in _STRING
}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_WORDS = frozenset("if for while fn def func function return match switch catch else in and or not await yield with except lambda class elif print_ loop impl where case typeof new".split())
_BINARY = frozenset("+ - * / % ** && || == != === !== < > <= >= & | ^ and or".split())
_COMPARE = frozenset("== != < > <= >= in is not".split())


class Code:
    def __init__(self, text: str, lang: str):
        self.text, self.lang = text, "javascript" if lang == "typescript" else lang
        self.toks: list[tuple[str, str, int, int]] = []
        self.pair: dict[int, int] = {}
        self.lex()
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]

    def lex(self) -> None:
        at, stack, rx = 0, [], _LEXERS[self.lang]
        while at < len(self.text):
            if self.lang == "javascript" and self.text[at] == "/" and self.operand_due() and (m := _REGEX.match(self.text, at)):
                kind = "regex"
            else:
                m = rx.match(self.text, at)
                kind = m.lastgroup
            at = m.end()
            if kind in ("comment", "space", "life"):
                continue
            i = len(self.toks)
            self.toks.append((kind, m[0], m.start(), m.end()))
            if kind == "punct" and m[0] in _OPEN:
                stack.append(i)
            elif kind == "punct" and m[0] in _CLOSE and stack:
                self.pair[i] = stack.pop()
                self.pair[self.pair[i]] = i
        for i in stack:
            self.pair[i] = len(self.toks)

    def operand_due(self) -> bool:
        """Whether a value may begin here, so that a slash begins a regular expression."""
        for kind, t, _, _ in reversed(self.toks):
            if kind != "nl":
                return kind == "punct" and t not in _CLOSE or kind == "ident" and t in ("return", "typeof", "case", "in")
        return True

    def t(self, i: int) -> str:
        return self.toks[i][1] if 0 <= i < len(self.toks) else ""

    def k(self, i: int) -> str:
        return self.toks[i][0] if 0 <= i < len(self.toks) else ""

    def back(self, i: int) -> int:
        i -= 1
        while i >= 0 and self.k(i) == "nl":
            i -= 1
        return i

    def ahead(self, i: int) -> int:
        i += 1
        while i < len(self.toks) and self.k(i) == "nl":
            i += 1
        return i

    def chain(self, i: int) -> tuple[list[str], list[str], int, int]:
        """Parts and separators of the dotted or scoped name that ends at token i, its first token, and the bracket before a part-less start (or -1)."""
        parts, seps, first = [self.t(i)], [], i
        while self.t(j := self.back(first)) in (".", "::", "?."):
            k = self.back(j)
            seps.insert(0, "::" if self.t(j) == "::" else ".")
            if self.k(k) == "ident":
                parts.insert(0, self.t(k))
                first = k
            else:
                return parts, seps, k, k if self.t(k) == ")" else -2
        return parts, seps, first, -1

    def kind_of(self, sep: str | None) -> str:
        if sep is None:
            return "ident"
        return "scoped" if sep == "::" else {"rust": "field", "python": "attr", "javascript": "member", "go": "selector"}[self.lang]

    def inner(self, i: int) -> list[tuple[int, int]]:
        """Ranges of tokens between commas within the bracket at i."""
        out, at, j, end = [], i + 1, i + 1, min(self.pair.get(i, len(self.toks)), len(self.toks))
        while j < end:
            if self.t(j) in _OPEN and self.k(j) == "punct":
                j = self.pair.get(j, end)
            elif self.t(j) == "," and self.k(j) == "punct":
                out.append((at, j))
                at = j + 1
            j += 1
        out.append((at, end))
        trimmed = [([x for x in range(a, min(b, len(self.toks))) if self.k(x) != "nl"]) for a, b in out]
        return [(x[0], x[-1] + 1) for x in trimmed if x]

    def src(self, a: int, b: int) -> str:
        return self.text[self.toks[a][2] : self.toks[min(b, len(self.toks)) - 1][3]] if a < b and a < len(self.toks) else ""

    def value(self, a: int, b: int) -> dict:
        """What kind of expression the tokens are."""
        out = dict.fromkeys(["op", "name", "callee_kind", "left_kind", "left_text"])
        out["text"] = self.src(a, b)
        ops, j = [], a
        while j < b:
            if self.k(j) == "punct" and self.t(j) in _OPEN:
                j = self.pair.get(j, b)
            elif (self.t(j) in _BINARY) and j > a and (self.k(j) == "punct" or self.lang == "python") and not (self.k(j - 1) == "punct" and self.t(j - 1) not in _CLOSE):
                ops.append(j)
            j += 1
        single = {"str": "string", "tmpl": "template", "num": "number", "regex": "regex", "ident": "ident"}
        if ops:
            low = [o for o in ops if self.t(o) in ("+", "-")] or ops
            o = low[-1]
            left = self.value(a, o)
            return out | {"kind": "binary", "op": self.t(o), "left_kind": left["kind"], "left_text": left["text"]}
        if b - a == 1:
            return out | {"kind": {"true": "true", "True": "true"}.get(self.t(a), single.get(self.k(a), "other"))}
        if self.t(a) == "chan":
            return out | {"kind": "chan_type"}
        if self.t(b - 1) == ")" and (o := self.pair.get(b - 1, -1)) > a and self.k(self.back(o)) == "ident":
            parts, seps, _, _ = self.chain(self.back(o))
            return out | {"kind": "call", "name": parts[-1], "callee_kind": self.kind_of(seps[-1] if seps else None)}
        return out | {"kind": {"[": "array", "{": "object"}.get(self.t(a), "other")}

    def node(self, kind: str, a: int, b: int, **own) -> tuple:
        """From token a to before token b."""
        s, e = self.toks[a][2], self.toks[min(b, len(self.toks)) - 1][3]
        pos = []
        for at in (s, e):
            line = bisect.bisect_right(self.lines, at)
            pos += [line, len(self.text[self.lines[line - 1] : at].encode()) + 1]
        own |= {"kind": kind, "text": self.text[s:e], "before": self.text[max(0, s - 200) : s], "start_line": pos[0], "start_column": pos[1], "end_line": pos[2], "end_column": pos[3]}
        return tuple(own.get(n) for n in NAMES)

    def statement_end(self, i: int) -> int:
        """The end of a statement that begins at i: a semicolon or a line's end outside of brackets."""
        while i < len(self.toks) and self.t(i) != ";" and self.k(i) != "nl" and self.t(i) not in _CLOSE:
            i = self.pair.get(i, len(self.toks)) + 1 if self.t(i) in _OPEN and self.k(i) == "punct" else i + 1
        return i

    def loop_of(self, i: int) -> int:
        """The for whose body is the block that directly holds token i, or -1."""
        depth = i
        j = i - 1
        while j >= 0:
            if self.k(j) == "punct" and self.t(j) in _CLOSE and j in self.pair:
                j = self.pair[j]
            elif self.k(j) == "punct" and self.t(j) in _OPEN:
                depth = j
                break
            j -= 1
        if j < 0 or self.t(depth) != "{":
            return -1
        j = self.back(depth)
        while j >= 0 and self.t(j) not in (";", "{", "}") and self.k(j) != "nl":
            if self.t(j) == "for" and self.k(j) == "ident":
                return j
            j -= 1
        # the parts of a for clause are parted by semicolons
        while self.lang == "go" and j >= 0 and self.k(j) != "nl" and self.t(j) not in ("{", "}"):
            if self.t(j) == "for":
                return j
            j -= 1
        return -1

    def nodes(self) -> Iterator[tuple]:
        lang = self.lang
        for i, (kind, t, _, _) in enumerate(self.toks):
            nxt = self.ahead(i)
            if kind == "punct" and t == "(" and self.k(p := self.back(i)) == "ident" and (self.t(p) not in _WORDS or self.t(self.back(p)) in (".", "::", "?.")):
                yield from self.call(i, p)
            elif kind == "ident" and lang == "rust":
                yield from self.rust(i, t, nxt)
            elif kind == "punct" and lang == "rust" and t == "*" and self.k(nxt) == "ident" and nxt == i + 1 and not (self.k(p := self.back(i)) in ("ident", "num", "str") and self.t(p) not in _WORDS or self.t(p) in _CLOSE):
                yield self.node("unary", i, nxt + 1, op="*", lhs=self.t(nxt), lhs_kind="ident")
            elif kind == "ident" and lang == "python":
                yield from self.python(i, t, nxt)
            elif lang == "javascript":
                yield from self.javascript(i, kind, t, nxt)
            elif lang == "go":
                yield from self.go(i, kind, t, nxt)

    def call(self, i: int, p: int) -> Iterator[tuple]:
        parts, seps, first, bracket = self.chain(p)
        before = self.t(self.back(first)) if bracket == -1 else ""
        if before in ("fn", "def", "func", "function", "class"):
            return
        own = {"name": parts[-1], "path": parts, "callee_kind": self.kind_of(seps[-1] if seps else None)}
        if bracket == -1 and len(parts) == 2:
            own["recv"] = parts[0]
        if bracket >= 0 and len(parts) == 1 and self.k(q := self.back(self.pair.get(bracket, 0))) == "ident":
            own["recv_path"] = self.chain(q)[0]
            first = self.chain(q)[2]
        elif bracket >= 0:
            first = self.pair.get(bracket, first)
        end = min(self.pair.get(i, len(self.toks) - 1), len(self.toks) - 1) + 1
        args = [self.value(a, b) for a, b in self.inner(i)]
        yield self.node("call", max(0, first), end, args=args, args_text=self.src(i, end), **own)
        if self.lang == "rust" and own["name"] == "push" and own["callee_kind"] == "field" and self.t(self.ahead(end - 1)) == "}" and self.t(self.back(max(0, first))) in ("{", ";", "}") and (f := self.loop_of(max(0, first))) >= 0:
            yield self.node("push_in_loop", f, self.ahead(end - 1) + 1, **own)

    def rust(self, i: int, t: str, nxt: int) -> Iterator[tuple]:
        if t == "unsafe" and self.t(nxt) == "{":
            yield self.node("unsafe_block", i, self.pair.get(nxt, len(self.toks)) + 1)
        elif t == "unsafe" and self.t(nxt) in ("fn", "extern", "impl"):
            end = nxt
            while end < len(self.toks) and self.t(end) not in ("{", ";"):
                end += 1
            is_fn = "fn" in [self.t(x) for x in range(nxt, end)] and self.t(nxt) != "impl"
            if is_fn or self.t(nxt) == "impl":
                yield self.node("fn_item" if is_fn else "impl_item", i, self.pair.get(end, end) + 1, op="unsafe")
        elif t == "let":
            j = self.ahead(nxt) if self.t(nxt) == "mut" else nxt
            end, eq = self.statement_end(i), j + 1
            while eq < end and self.t(eq) != "=":
                eq += 1
            if self.k(j) == "ident" and self.t(j + 1) in ("=", ":") and eq < end:
                v = self.value(eq + 1, end)
                yield self.node("let", i, end + 1, lhs=self.t(j), lhs_kind="ident", rhs=v["text"], rhs_kind=v["kind"])
        elif t == "use":
            end = self.statement_end(i)
            own = [self.t(x) for x in range(nxt, end)]
            yield self.node("use", i, end + 1, rhs="".join(own), rhs_kind="scoped" if "::" in own and not {"{", "*", "as"} & set(own) else "other")
        elif self.t(i + 1) == "!" and self.t(self.ahead(i + 1)) in _OPEN and self.t(i - 1) != "::":
            yield self.node("macro", i, min(self.pair.get(self.ahead(i + 1), len(self.toks)), len(self.toks) - 1) + 1, name=t)

    def python(self, i: int, t: str, nxt: int) -> Iterator[tuple]:
        begins = i == 0 or self.k(i - 1) == "nl" or self.t(i - 1) in (";", ":")
        end = self.statement_end(i)
        if not begins:
            return
        if t == "assert":
            comma = next((x for x in range(i, end) if self.t(x) == ","), end)
            v = [self.t(x) for x in range(nxt, comma)]
            yield self.node("assert", i, end, lhs_kind="comparison" if set(v) & _COMPARE and not {"and", "or"} & set(v) else "other")
        elif t == "from":
            stop = next((x for x in range(i, end) if self.t(x) == "import"), -1)
            if stop > 0 and self.t(nxt) != ".":
                yield self.node("import_from", i, end, name="".join(self.t(x) for x in range(nxt, stop)))
        else:
            eq = next((x for x in range(i + 1, min(end, i + 40)) if self.t(x) == "=" and self.k(x) == "punct"), -1)
            if self.t(i + 1) in ("=", ":") and eq > 0 and eq + 1 < end:
                v = self.value(eq + 1, end)
                yield self.node("assign", i, end, lhs=t, lhs_kind="ident", rhs=v["text"], rhs_kind=v["kind"])

    def javascript(self, i: int, kind: str, t: str, nxt: int) -> Iterator[tuple]:
        if kind == "regex":
            yield self.node("regex", i, i + 1, rhs=t[1 : t.rindex("/")])
        elif kind == "punct" and t == "=" and self.k(self.back(i)) == "ident":
            parts, seps, first, bracket = self.chain(self.back(i))
            end = self.statement_end(nxt)
            if seps:
                yield self.node("assign", max(0, first if bracket < 0 else self.pair.get(bracket, 0)), end, lhs=parts[-1], lhs_kind="member")
            elif self.declares(first):
                stop = next((x for x in range(nxt, end) if self.t(x) == "," and self.same_depth(nxt, x)), end)
                v = self.value(nxt, stop)
                yield self.node("var_decl", first, stop, lhs=parts[-1], lhs_kind="ident", rhs=v["text"], rhs_kind=v["kind"], op="export" if self.exported(first) else None)

    def same_depth(self, a: int, x: int) -> bool:
        j = a
        while j < x:
            if self.t(j) in _OPEN and self.k(j) == "punct":
                j = self.pair.get(j, x)
            j += 1
        return j == x

    def declaration(self, i: int) -> int:
        """The const, let or var that the name at i belongs to, or -1."""
        j = i - 1
        while j >= 0 and self.t(j) not in (";", "{", "}") :
            if self.t(j) in ("const", "let", "var") and self.k(j) == "ident":
                return j
            if self.k(j) == "nl" and self.t(self.back(j)) not in (",", "const", "let", "var", "="):
                return -1
            j = self.pair.get(j, j) - 1 if self.t(j) in _CLOSE else j - 1
        return -1

    def declares(self, i: int) -> bool:
        return (d := self.declaration(i)) >= 0 and (self.t(self.back(i)) in ("const", "let", "var", ",")) and d < i

    def exported(self, i: int) -> bool:
        d = self.declaration(i)
        return self.t(self.back(d)) == "export" and self.t(d) in ("const", "let")

    def go(self, i: int, kind: str, t: str, nxt: int) -> Iterator[tuple]:
        if kind == "punct" and t in (":=", "="):
            first = i - 1
            while first > 0 and (self.k(first - 1) == "ident" and self.t(first) == "," or self.t(first - 1) == ","):
                first -= 1
            left = [self.t(x) for x in range(first, i) if self.k(x) == "ident"]
            if not left or self.k(i - 1) != "ident":
                return
            end = self.statement_end(nxt)
            right, at = [], nxt
            for x in [*(x for x in range(nxt, end) if self.t(x) == "," and self.same_depth(nxt, x)), end]:
                if at < x:
                    right.append(self.value(at, x))
                at = x + 1
            kinds = {"lhs_kind": "ident"}
            for name in left:
                for v in right:
                    yield self.node("short_var" if t == ":=" else "assign", first, end, lhs=name, rhs=v["text"], rhs_kind="string" if v["kind"] == "string" and v["text"].startswith('"') else v["kind"], **kinds)
        elif kind == "ident" and self.t(i + 1) == ":" and self.t(self.ahead(i + 1)) in ("true", "false"):
            yield self.node("keyed_element", i, self.ahead(i + 1) + 1, name=t, rhs=self.t(self.ahead(i + 1)))
        elif kind == "ident" and t == "defer" and (f := self.loop_of(i)) >= 0:
            yield self.node("defer_in_loop", f, self.statement_end(i))


def nodes(text: str, lang: str) -> list[tuple]:
    return list(Code(text, lang).nodes()) if lang in ("rust", "python", "javascript", "typescript", "go") else []


def _kinds() -> dict[str, pa.DataType]:
    s = pa.string()
    arg = pa.struct([(k.split(":")[0], s) for k in ARG[7:-1].split(",")])
    return {n: pa.int32() if n.endswith(("_line", "_column")) else pa.list_(s) if n in ("path", "recv_path") else pa.list_(arg) if n == "args" else s for n in NAMES}


def parsed(files: DataFrame) -> DataFrame:
    """files (repo, path, language, content) as nodes, with ordinal, the place of a node in its file. Null content has none."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _kinds()
        for batch in batches:
            for repo, path, lang, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rows = nodes(text, lang) if text and lang else []
                for i in range(0, len(rows), 10_000):
                    part = rows[i : i + 10_000]
                    cols = list(zip(*part, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([repo] * len(part), pa.string()), pa.array([path] * len(part), pa.string()), pa.array([lang] * len(part), pa.string()), pa.array(range(i, i + len(part)), pa.int32()), *[pa.array(c, kinds[n]) for n, c in zip(NAMES, cols, strict=True)]], ["repo", "file", "language", "ordinal", *NAMES])

    src = files.select(F.col("repo").cast("string"), F.col("path").cast("string"), F.col("language").cast("string"), F.col("content").cast("string"))
    return src.mapInArrow(run, f"repo string, file string, language string, ordinal int, {NODE}")
