"""Sources parsed to nested modules: Python by its own grammar, the languages with braces by a scanner on text whose comments and strings
are blanked out.

parse() never fails: what can't be parsed is a module with ``error``.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

CALL = "struct<callee:string,line:int,is_method_call:boolean,receiver:string>"
PARAMETER = "struct<name:string,type_annotation:string,default_value:string,is_variadic:boolean,is_keyword:boolean>"
FUNCTION = f"struct<name:string,parameters:array<{PARAMETER}>,return_type:string,decorators:array<string>,is_async:boolean,is_method:boolean,is_static:boolean,is_classmethod:boolean,is_property:boolean,docstring:string,body_complexity:int,body_source:string,call_sites:array<{CALL}>,start_line:int,end_line:int>"
CLASS = f"struct<name:string,bases:array<string>,decorators:array<string>,methods:array<{FUNCTION}>,attributes:array<string>,docstring:string,start_line:int,end_line:int,referenced_types:array<string>>"
IMPORT = "struct<module:string,names:array<string>,alias:string,is_from:boolean,is_dynamic:boolean,dynamic_pattern:string,dynamic_source:string,line_number:int>"
MODULE = f"struct<name:string,path:string,language:string,imports:array<{IMPORT}>,classes:array<{CLASS}>,functions:array<{FUNCTION}>,module_docstring:string,total_lines:int,namespace:string,error:string>"

# Names of the languages that have a parser.
SUPPORTED = ("python", "py", "typescript", "ts", "tsx", "javascript", "js", "jsx", "go", "java", "rust", "rs", "csharp", "cs", "c#")
_ALIASES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "rs": "rust", "cs": "csharp", "c#": "csharp"}

_TYPE_NAME = re.compile(r"\b([A-Z][a-zA-Z0-9_]*)\b")


def referenced_types(annotations: list[str], own: str, builtins: frozenset[str] = frozenset()) -> list[str]:
    """Capitalised names in annotations, without the class itself and the language's own types; sorted."""
    return sorted({t for a in annotations for t in _TYPE_NAME.findall(a)} - {own} - builtins)


#: Types that a language brings along and that are no references.
BUILTINS = {
    "python": frozenset("Any Optional Union List Dict Set Tuple Callable Iterator Iterable Generator Type TypeVar Generic Protocol Literal Final ClassVar Annotated None True False Self".split()),
    "typescript": frozenset("Array Promise Record Partial Required Readonly Pick Omit Map Set Date Error Function Object String Number Boolean Symbol RegExp".split()),
    "go": frozenset(),
    "java": frozenset("String Integer Long Double Float Boolean Byte Short Character Object List Map Set Collection Optional Void Iterable Iterator Stream".split()),
    "rust": frozenset("String Vec Option Result Box Rc Arc RefCell Cell Mutex RwLock HashMap HashSet BTreeMap BTreeSet Self Some None Ok Err".split()),
    "csharp": frozenset("String Int32 Int64 Boolean Double Decimal Object List Dictionary IEnumerable IList ICollection Task Action Func Nullable DateTime Guid".split()),
}
BUILTINS["javascript"] = BUILTINS["typescript"]


def _function(name: str, **known) -> dict:
    base = {"name": name, "parameters": [], "return_type": None, "decorators": [], "is_async": False, "is_method": False, "is_static": False, "is_classmethod": False, "is_property": False, "docstring": None, "body_complexity": 1, "body_source": None, "call_sites": [], "start_line": 0, "end_line": 0}
    return base | known


def _class(name: str, language: str, **known) -> dict:
    found = {"name": name, "bases": [], "decorators": [], "methods": [], "attributes": [], "docstring": None, "start_line": 0, "end_line": 0} | known
    annotations = [t for m in found["methods"] for t in [m["return_type"], *(p["type_annotation"] for p in m["parameters"])] if t]
    return found | {"referenced_types": referenced_types(annotations, name, BUILTINS.get(language, frozenset()))}


def _import(module: str, line: int, **known) -> dict:
    return {"module": module, "names": [], "alias": None, "is_from": False, "is_dynamic": False, "dynamic_pattern": None, "dynamic_source": None, "line_number": line} | known


def _parameter(name: str, kind: str | None = None, default: str | None = None, variadic: bool = False, keyword: bool = False) -> dict:
    return {"name": name, "type_annotation": kind, "default_value": default, "is_variadic": variadic, "is_keyword": keyword}


# --- Python --------------------------------------------------------------------------------------------------------

_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.comprehension, ast.IfExp, ast.Match, ast.match_case)


#: Nodes below which there is nothing to find: names and constants.
_LEAVES = frozenset((ast.Name, ast.Constant))


def _below(nodes: list[ast.AST]) -> list[ast.AST]:
    """What ast.walk() meets, in its order, without the context of names and the like: it takes most of the time of a parse."""
    found = list(nodes)
    for x in found:
        if type(x) in _LEAVES:
            continue
        for field in x._fields:
            inner = getattr(x, field, None)
            if isinstance(inner, list):
                found += [y for y in inner if isinstance(y, ast.AST)]
            elif isinstance(inner, ast.AST) and inner._fields:
                found.append(inner)
    return found


def _text(node: ast.AST) -> str:
    """ast.unparse(), which names and dotted names don't need."""
    if type(node) is ast.Name:
        return node.id
    if type(node) is ast.Attribute and type(node.value) in (ast.Name, ast.Attribute):
        return f"{_text(node.value)}.{node.attr}"
    return ast.unparse(node)


def _python_complexity(below: list[ast.AST]) -> int:
    total = 1
    for x in below:
        if isinstance(x, _BRANCHES):
            total += 1 + (len(x.ifs) if isinstance(x, ast.comprehension) else 0)
        elif isinstance(x, ast.BoolOp):
            total += len(x.values) - 1
    return total


def _python_calls(below: list[ast.AST]) -> list[dict]:
    found = []
    for x in below:
        if isinstance(x, ast.Call):
            text, receiver = _text(x.func), None
            if isinstance(x.func, ast.Attribute):
                receiver = _text(x.func.value)
                text = x.func.attr if receiver in ("self", "cls") else text
            found.append((x.lineno, x.col_offset, {"callee": text, "line": x.lineno, "is_method_call": receiver is not None, "receiver": receiver}))
    return [c for _, _, c in sorted(found, key=lambda f: f[:2])]


def _python_decorators(node) -> list[str]:
    return [_text(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]


def _python_parameters(a: ast.arguments) -> list[dict]:
    text = lambda x: _text(x) if x is not None else None
    plain = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    found = [_parameter(p.arg, text(p.annotation), text(d)) for p, d in zip(plain, defaults, strict=True)]
    if a.vararg:
        found.append(_parameter(a.vararg.arg, text(a.vararg.annotation), variadic=True))
    found += [_parameter(p.arg, text(p.annotation), text(d)) for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    return [*found, _parameter(a.kwarg.arg, text(a.kwarg.annotation), keyword=True)] if a.kwarg else found


def _python_function(node, lines: list[str], method: bool) -> dict:
    marks, below = _python_decorators(node), _below(node.body)
    return _function(
        node.name, parameters=_python_parameters(node.args), return_type=_text(node.returns) if node.returns else None, decorators=marks, is_async=isinstance(node, ast.AsyncFunctionDef), is_method=method,
        is_static="staticmethod" in marks, is_classmethod="classmethod" in marks, is_property="property" in marks, docstring=ast.get_docstring(node), body_complexity=_python_complexity(below),
        body_source="\n".join(lines[node.body[0].lineno - 1 : node.end_lineno]), call_sites=_python_calls(below), start_line=node.lineno, end_line=node.end_lineno,
    )


def _python_imports(tree: ast.Module, source: str) -> Iterator[dict]:
    for node in tree.body:
        if isinstance(node, ast.Import):
            first, *more = node.names
            yield _import(first.name, node.lineno, names=[n.name for n in more], alias=next((n.asname for n in node.names if n.asname), None))
        elif isinstance(node, ast.ImportFrom):
            yield _import("." * node.level + (node.module or ""), node.lineno, names=[n.name for n in node.names], alias=next((n.asname for n in node.names if n.asname), None), is_from=True)
    # Identifiers are read in normal form, so that in other than ASCII text they may be written in other characters.
    if source.isascii() and "__import__" not in source and "import_module" not in source:
        return
    for node in _below([tree]):
        if isinstance(node, ast.Call) and node.args:
            called = _text(node.func)
            how = "__import__" if called == "__import__" else "importlib" if called.endswith(".import_module") else None
            if how:
                first = node.args[0]
                known = isinstance(first, ast.Constant) and isinstance(first.value, str)
                yield _import(first.value if known else "<dynamic>", node.lineno, is_dynamic=True, dynamic_pattern=None if known else ast.unparse(first), dynamic_source=how)


def _python(path: str, source: str) -> dict:
    tree = ast.parse(source)
    functions, classes, lines = [], [], source.split("\n")
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            functions.append(_python_function(node, lines, False))
        elif isinstance(node, ast.ClassDef):
            methods = [_python_function(x, lines, True) for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
            attributes = [t.id for x in node.body if isinstance(x, (ast.Assign, ast.AnnAssign)) for t in (x.targets if isinstance(x, ast.Assign) else [x.target]) if isinstance(t, ast.Name)]
            bases = [_text(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
            classes.append(_class(node.name, "python", bases=bases, decorators=_python_decorators(node), methods=methods, attributes=attributes, docstring=ast.get_docstring(node), start_line=node.lineno, end_line=node.end_lineno))
    return {"imports": list(_python_imports(tree, source)), "classes": classes, "functions": functions, "module_docstring": ast.get_docstring(tree)}


# --- languages with braces -------------------------------------------------------------------------------------------

_HIDDEN = re.compile(r'//[^\n]*|/\*.*?\*/|@"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`|\'(?:\\.|[^\'\\\n])\'|\'(?:\\.|[^\'\\\n])*\'', re.S)
_RUST_HIDDEN = re.compile(r'//[^\n]*|/\*.*?\*/|r#*"(?:.*?)"#*|"(?:\\.|[^"\\])*"|\'(?:\\.[^\']*|[^\'\\\n])\'', re.S)
_COMMON = "if for while switch catch return new else do case throw in this super try default"
#: Words before a bracket that call nothing.
_WORDS = {k: frozenset(f"{_COMMON} {v}".split()) for k, v in {"typescript": "function typeof await of instanceof void yield delete import", "go": "func go defer select range map chan struct interface", "java": "instanceof synchronized assert", "rust": "fn match loop await unsafe move impl where pub mut ref as", "csharp": "using lock foreach sizeof nameof when typeof await base is"}.items()}
_WORDS["javascript"] = _WORDS["typescript"]
_CALL_SITE = re.compile(r"(?<![\w.:$])(new\s+)?([A-Za-z_$][\w$]*(?:(?:\?\.|\.|::)[A-Za-z_$][\w$]*)*)(!)?\s*(?:<[\w\s,.<>\[\]]*>)?\s*([(\[{])")


class Text:
    """A source with comments and strings blanked out: ``code`` has the same length, so that places are places of the source."""

    def __init__(self, source: str, language: str):
        blank = lambda m: m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if m[0][0] in "\"'`" and len(m[0]) > 1 else re.sub(r"[^\n]", " ", m[0])
        self.source, self.language = source, language
        self.code = (_RUST_HIDDEN if language == "rust" else _HIDDEN).sub(blank, source)
        self.lines = [m.start() for m in re.finditer("\n", source)]

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_left(self.lines, at) + 1

    def close(self, at: int, pair: str = "{}") -> int:
        """Where the bracket at ``at`` closes; the end of the text if it doesn't."""
        depth = 0
        for m in re.compile("[" + re.escape(pair) + "]").finditer(self.code, at):
            depth += 1 if m[0] == pair[0] else -1
            if depth == 0:
                return m.start()
        return len(self.code) - 1

    def depth(self, start: int, end: int) -> Iterator[tuple[int, int]]:
        """The stretches of [start, end) outside inner braces."""
        at = start
        for m in re.compile(r"\{").finditer(self.code, start, end):
            if m.start() < at:
                continue
            yield at, m.start() + 1
            at = self.close(m.start())
        yield at, end


# What adds to a function's complexity, by language.
_DECISIONS = {
    "typescript": r"\bif\b|\bfor\b|\bwhile\b|\bdo\b|\bcase\b|\bcatch\b|\?\?|(?<!\?)\?(?![?.:])|&&|\|\|",
    "go": r"\bif\b|\bfor\b|\bcase\b|&&|\|\|",
    "java": r"\bif\b|\bfor\b|\bwhile\b|\bdo\b|\bcase\b|\bdefault\b|\bcatch\b|\?(?![>,\s]*(?:super|extends|>))|&&|\|\|",
    "rust": r"\bif\b|\bfor\b|\bwhile\b|\bloop\b|\bmatch\b|=>|&&|\|\|",
    "csharp": r"\bif\b|\bfor\b|\bforeach\b|\bwhile\b|\bdo\b|\bcase\b|\bdefault\s*:|\bcatch\b|\?\?|\?\.|(?<!\?)\?(?=\s)|&&|\|\|",
}
_DECISIONS["javascript"] = _DECISIONS["typescript"]
_SELF = frozenset(("self", "this", "super", "base", "Self"))


def _complexity(t: Text, start: int, end: int) -> int:
    body = t.code[start:end]
    # The while at the end of do { } while (x); is part of its do.
    return 1 + len(re.findall(_DECISIONS[t.language], body)) - len(re.findall(r"\bdo\b", body) if t.language != "go" and t.language != "rust" else ())


def _calls(t: Text, start: int, end: int) -> list[dict]:
    found = []
    for m in _CALL_SITE.finditer(t.code, start, end):
        name, first = m[2].replace("?.", "."), re.split(r"\?\.|\.|::", m[2])[0]
        if (m[4] != "(" and not m[3]) or (first in _WORDS[t.language] and first not in _SELF) or t.code[max(start, m.start() - 5) : m.start()].rstrip().endswith(("func", "fn")):
            continue
        receiver, _, last = name.replace("::", ".").rpartition(".") if "::" not in name else name.rpartition("::")
        if t.language == "csharp":
            name = last or name
        elif receiver in _SELF and t.language != "go":
            name = last
        method = bool(receiver) and "::" not in m[2] or (t.language == "rust" and bool(receiver))
        found.append({"callee": name + (m[3] or ""), "line": t.line(m.start()), "is_method_call": bool(method), "receiver": receiver or None})
    return found


def _split(text: str) -> list[str]:
    """Parts of a list at commas outside brackets."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}" or (c == ">" and text[i - 1] not in "=-"))
        if c == "," and depth == 0:
            parts.append(text[last:i])
            last = i + 1
    return [p.strip() for p in [*parts, text[last:]] if p.strip()]


def _parameters(text: str, language: str) -> list[dict]:
    found = []
    for part in _split(text):
        part, _, default = (x.strip() for x in part.partition("=")) if "=>" not in part.split("=")[0] + "=" else (part, "", "")
        default = default or None
        if language in ("typescript", "javascript"):
            name, _, kind = (x.strip() for x in part.partition(":"))
            name = re.sub(r"^(?:(?:public|private|protected|readonly)\s+)+", "", name)
            found.append(_parameter(name.lstrip(".").rstrip("?"), kind or None, default, part.startswith("...")))
        elif language == "rust":
            if re.fullmatch(r"&?\s*(?:'\w+\s+)?(?:mut\s+)?self(?:\s*:.*)?", part):
                continue
            name, _, kind = (x.strip() for x in part.partition(":"))
            found.append(_parameter(re.sub(r"^mut\s+", "", name), kind or None))
        elif language == "go":
            name, _, kind = part.partition(" ")
            found.append(_parameter(name, kind.strip() or None, None, "..." in kind))
        else:
            words = re.sub(r"^(?:(?:@\w+(?:\([^)]*\))?|\[[^\]]*\]|final|this|ref|out|in|params)\s+)+", lambda m: "", part)
            kind, _, name = words.rpartition(" ")
            found.append(_parameter(name, kind.strip() or None, default, "..." in kind or part.startswith("params ")))
    if language == "go":
        # A list a, b int gives its type to the names before.
        kind = None
        for p in reversed(found):
            kind = p["type_annotation"] = p["type_annotation"] or kind
    return found


def _made(t: Text, name: str, at: int, open_list: int, body: int | None, **known) -> dict:
    """A function whose list of parameters opens at ``open_list`` and whose body, if any, at ``body``."""
    end = t.close(body) if body is not None else t.close(open_list, "()")
    params = _parameters(t.source[open_list + 1 : t.close(open_list, "()")], t.language)
    inside = {"body_complexity": _complexity(t, body, end), "call_sites": _calls(t, body + 1, end), "body_source": t.source[body : end + 1]} if body is not None else {}
    return _function(name, parameters=params, start_line=t.line(at), end_line=t.line(end), **inside, **known)


def _body(t: Text, at: int, end: int) -> tuple[int | None, str]:
    """Behind a list of parameters: where the body opens (None for a declaration), and what stands before it."""
    m = re.compile(r"[{;]|=>").search(t.code, at, end)
    if not m or m[0] == ";":
        return None, t.code[at : m.start() if m else end].strip()
    if m[0] == "=>":
        brace = re.compile(r"\s*\{").match(t.code, m.end(), end)
        return (brace.end() - 1 if brace else None), t.code[at : m.start()].strip()
    return m.start(), t.code[at : m.start()].strip()


_JS_IMPORT = re.compile(r"""\bimport\s+(?:type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\*\s+as\s+([\w$]+)\s*)?(?:\{([^}]*)\}\s*)?(?:from\s*)?["']([^"']+)["']|\bexport\s+(?:\*|\{([^}]*)\})\s*from\s*["']([^"']+)["']""")
_JS_DYNAMIC = re.compile(r"""\b(import|require)\s*\(\s*([^)]*?)\s*\)""")
_JS_CLASS = re.compile(r"\b(?:(abstract)\s+)?(class|interface)\s+([A-Za-z_$][\w$]*)(?:\s*<[^{]*?>)?\s*(?:extends\s+([^{]+?))?\s*(?:implements\s+([^{]+?))?\s*\{")
_JS_FUNCTION = re.compile(r"\b(async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\s*\(")
_JS_ARROW = re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+?)?=\s*(async\s+)?(?:<[^(]*>)?\(")
_JS_METHOD = re.compile(r"(?:^|[;}{\n])\s*((?:(?:public|private|protected|static|async|readonly|abstract|override|get|set)\s+)*)([A-Za-z_$#][\w$]*)\s*\??\s*(?:<[^(]*>)?\(")
_JS_FIELD = re.compile(r"(?:^|[;}{\n])\s*(?:(?:public|private|protected|static|readonly|declare)\s+)*([A-Za-z_$#][\w$]*)[?!]?\s*(?::|=(?!>))")


def _typescript(t: Text) -> dict:
    imports, classes, functions, spans = [], [], [], []
    for m in _JS_IMPORT.finditer(t.source):
        if t.code[m.start()] == " ":
            continue  # in a comment or a string
        listed = m[3] or m[5] or ""
        names = [re.split(r"\s+as\s+", n.strip())[0].removeprefix("type ").strip() for n in listed.split(",") if n.strip()]
        imports.append(_import(m[4] or m[6], t.line(m.start()), names=([m[1]] if m[1] else []) + names, alias=m[2], is_from=True))
    for m in _JS_CLASS.finditer(t.code):
        end = t.close(m.end() - 1)
        spans.append((m.start(), end))
        bases = [re.sub(r"<.*", "", b).strip() for part in (m[4], m[5]) if part for b in _split(part)]
        methods, attributes = [], []
        for a, b in t.depth(m.end(), end):
            for f in _JS_METHOD.finditer(t.code, a - 1, b):
                open_list, marks = f.end() - 1, f[1].split()
                if f[2] in _WORDS[t.language] - {"delete", "import"}:
                    continue
                body, between = _body(t, t.close(open_list, "()") + 1, end)
                methods.append(_made(t, f[2], f.start(2), open_list, body, return_type=between.lstrip(":").strip() or None, is_async="async" in marks, is_method=True, is_static="static" in marks, is_property="get" in marks))
            attributes += [f[1] for f in _JS_FIELD.finditer(t.code, a - 1, b) if f[1] not in _WORDS[t.language]]
        seen: dict[tuple[str, int], dict] = {(f["name"], f["start_line"]): f for f in methods}
        classes.append(_class(m[3], t.language, bases=bases, decorators=["interface"] if m[2] == "interface" else ["abstract"] if m[1] else [], methods=list(seen.values()), attributes=list(dict.fromkeys(attributes)), start_line=t.line(m.start()), end_line=t.line(end)))
    outside = lambda at: not any(a < at < b for a, b in spans)
    for pattern, name, is_async in ((_JS_FUNCTION, 2, 1), (_JS_ARROW, 1, 2)):
        for m in pattern.finditer(t.code):
            if not outside(m.start()):
                continue
            open_list = m.end() - 1
            body, between = _body(t, t.close(open_list, "()") + 1, len(t.code))
            if pattern is _JS_ARROW and "=>" not in t.code[t.close(open_list, "()") : (body or len(t.code))][:200]:
                continue
            made = _made(t, m[name], m.start(), open_list, body, return_type=between.lstrip(":").strip() or None, is_async=bool(m[is_async]))
            functions.append(made)
            spans.append((m.start(), t.close(body) if body is not None else m.end()))
    for m in _JS_DYNAMIC.finditer(t.source):
        if t.code[m.start()] != " ":
            quoted = re.fullmatch(r"""["']([^"']+)["']""", m[2])
            imports.append(_import(quoted[1] if quoted else "<dynamic>", t.line(m.start()), is_dynamic=True, dynamic_pattern=None if quoted else m[2], dynamic_source="import()" if m[1] == "import" else "require"))
    return {"imports": imports, "classes": classes, "functions": sorted(functions, key=lambda f: f["start_line"])}


_GO_FUNCTION = re.compile(r"^func\s*(?:\(\s*(?:(\w+)\s+)?(\*?\s*[\w.\[\]]+)\s*\)\s*)?([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?\(", re.M)
_GO_TYPE = re.compile(r"^(?:type\s+|\t)([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?(struct|interface)\s*\{", re.M)


def _go(t: Text) -> dict:
    imports, classes, functions = [], [], []
    for m in re.finditer(r'^import\s+(?:([\w.]+)\s+)?"([^"]+)"|^import\s*\((.*?)\)', t.source, re.M | re.S):
        if m[2]:
            imports.append(_import(m[2], t.line(m.start()), alias=m[1]))
        else:
            imports += [_import(x[2], t.line(m.start(3) + x.start(2)), alias=x[1]) for x in re.finditer(r'(?:([\w.]+)\s+)?"([^"]+)"', m[3])]
    for m in _GO_TYPE.finditer(t.code):
        end = t.close(m.end() - 1)
        rows = [r.strip() for r in t.code[m.end() : end].split("\n") if r.strip()]
        embedded = [r.lstrip("*").strip() for r in rows if re.fullmatch(r"\*?[A-Za-z_][\w.]*", r)]
        fields = [n.strip() for r in rows if m[2] == "struct" and (x := re.match(r"((?:\w+\s*,\s*)*\w+)\s+\S", r)) for n in x[1].split(",")]
        methods = [_function(x[1], is_method=True, start_line=t.line(m.start()), end_line=t.line(m.start())) for r in rows if m[2] == "interface" and (x := re.match(r"(\w+)\s*\(", r))]
        classes.append(_class(m[1], "go", bases=embedded, decorators=[m[2], *(["exported"] if m[1][0].isupper() else [])], methods=methods, attributes=fields, start_line=t.line(m.start()), end_line=t.line(end)))
    for m in _GO_FUNCTION.finditer(t.code):
        open_list = m.end() - 1
        behind = t.close(open_list, "()") + 1
        eol = t.code.find("\n", behind)
        body = t.code.find("{", behind, eol if eol >= 0 else None)
        returns = t.code[behind : body if body >= 0 else eol].strip()
        marks = ([f"receiver:{m[2].replace(' ', '')}"] if m[2] else []) + (["exported"] if m[3][0].isupper() else [])
        functions.append(_made(t, m[3], m.start(), open_list, body if body >= 0 else None, return_type=returns or None, decorators=marks, is_method=bool(m[2])))
    package = re.search(r"^package\s+(\w+)", t.code, re.M)
    return {"imports": imports, "classes": classes, "functions": functions, "name": package[1] if package else None}


_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|virtual|override|async|readonly|partial|synchronized|native|default|extern|unsafe|new|strictfp|required)\s+)*"
_OO_CLASS = re.compile(r"((?:@\w+(?:\([^)]*\))?\s+|\[[^\]\n]*\]\s*)*)(" + _MODIFIERS + r")\b(class|interface|enum|record|struct|@interface)\s+(?:struct\s+|class\s+)?([A-Za-z_]\w*)([^{;]*?)\{")
_OO_METHOD = re.compile(r"((?:@\w+(?:\([^)]*\))?\s+|\[[^\]\n]*\]\s*)*)(" + _MODIFIERS + r")(?:<[^>(]+>\s*)?([A-Za-z_][\w.<>\[\],?\s]*?\s+)?([A-Za-z_]\w*)\s*(?:<[^>(]+>)?\(")
_CS_PROPERTY = re.compile(r"(" + _MODIFIERS + r")([A-Za-z_][\w.<>\[\],?]*)\s+([A-Za-z_]\w*)\s*(?:\{(?=\s*(?:(?:private|protected|internal)\s+)?(?:get|set|init)\b)|=>)")
_OO_FIELD = re.compile(r"[;{}\n]\s*" + _MODIFIERS + r"[A-Za-z_][\w.<>\[\],?]*\s+([A-Za-z_]\w*)\s*(?=[=;])")


def _bases(rest: str) -> list[str]:
    rest = re.sub(r"\bwhere\b.*", "", re.sub(r"^\s*(?:<[^{]*?>)?\s*(?:\([^)]*\))?", "", rest), flags=re.S)
    return [re.sub(r"<.*|\(.*", "", b, flags=re.S).strip() for part in re.split(r"\bextends\b|\bimplements\b|\bpermits\b|:", rest) if part.strip() for b in _split(part)]


def _marks(text: str) -> list[str]:
    return [re.sub(r"\(.*", "", x, flags=re.S).strip("@[] ") for x in re.findall(r"@\w+(?:\([^)]*\))?|\[[^\]\n]*\]", text)]


def _object_types(t: Text, start: int, end: int, into: list[dict], outer: str | None = None) -> list[str]:
    """Classes in [start, end), inner ones too; returns the names of the direct ones."""
    names, at = [], start
    while m := _OO_CLASS.search(t.code, at, end):
        close = t.close(m.end() - 1)
        kind, marks, words = m[3].lstrip("@"), _marks(m[1]), m[2].split()
        own: list[dict] = []
        inner = _object_types(t, m.end(), close, own, m[4])
        inside = [(c["_a"], c["_b"]) for c in own]
        methods, attributes = [], [f"class:{n}" for n in inner] if t.language == "java" else []
        for a, b in t.depth(m.end(), close):
            clear = lambda p: not any(x < p < y for x, y in inside)  # noqa: B023, E731
            for f in _OO_METHOD.finditer(t.code, a, b):
                open_list = f.end() - 1
                if f[4] in _WORDS[t.language] or not clear(f.start(4)) or not (f[3] or f[4] == m[4]) or (f[3] or "").split(" ")[0] in ("return", "new", "throw", "else", "await"):
                    continue
                body, _ = _body(t, t.close(open_list, "()") + 1, close)
                flags = f[2].split()
                methods.append(_made(t, f[4], f.start(4), open_list, body, return_type=(f[3] or "").strip() or None, decorators=_marks(f[1]) + [w for w in flags if w not in ("async",)], is_async="async" in flags, is_method=True, is_static="static" in flags))
            if t.language == "csharp":
                methods += [_function(p[3], return_type=p[2], is_method=True, is_property=True, is_static="static" in p[1].split(), start_line=t.line(p.start(3)), end_line=t.line(p.start(3))) for p in _CS_PROPERTY.finditer(t.code, a, min(b + 60, close)) if clear(p.start(3)) and p.start(3) < b and p[2] not in ("class", "new", "return")]
            attributes += [f[1] for f in _OO_FIELD.finditer(t.code, max(m.end() - 1, a - 1), b) if clear(f.start(1))]
        if kind == "enum":
            body = re.split(r";", t.code[m.end() : close])[0]
            attributes = [x[0] for p in _split(body) if (x := re.match(r"[A-Za-z_]\w*", re.sub(r"^(?:@\w+\s*)+", "", p)))]
        tags = [kind] if kind != "class" else []
        found = _class(m[4], t.language, bases=_bases(m[5]), decorators=marks + tags + words, methods=methods, attributes=list(dict.fromkeys(attributes)), start_line=t.line(m.start(3)), end_line=t.line(close))
        into.append(found | {"_a": m.start(), "_b": close})
        into += own
        names.append(m[4])
        at = close + 1
    return names


def _plain(classes: list[dict]) -> list[dict]:
    return [{k: v for k, v in c.items() if k not in ("_a", "_b")} for c in classes]


def _java(t: Text) -> dict:
    imports = []
    for m in re.finditer(r"^\s*import\s+(static\s+)?([\w.]+?)(\.\*)?\s*;", t.code, re.M):
        imports.append(_import(m[2], t.line(m.start(2)), names=["*"] if m[3] else [m[2].rpartition(".")[2]], alias="static" if m[1] else None, is_from=True))
    classes: list[dict] = []
    _object_types(t, 0, len(t.code), classes)
    package = re.search(r"^\s*package\s+([\w.]+)\s*;", t.code, re.M)
    return {"imports": imports, "classes": _plain(classes), "functions": [], "name": package[1] if package else None}


def _csharp(t: Text) -> dict:
    imports = []
    for m in re.finditer(r"^\s*(?:global\s+)?using\s+(static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;", t.code, re.M):
        imports.append(_import(m[3], t.line(m.start(3)), alias=m[2] or ("static" if m[1] else None)))
    classes: list[dict] = []
    _object_types(t, 0, len(t.code), classes)
    space = re.search(r"^\s*namespace\s+([\w.]+)", t.code, re.M)
    return {"imports": imports, "classes": _plain(classes), "functions": [], "namespace": space[1] if space else None}


_RUST_TYPE = re.compile(r"((?:#\[[^\]]*\]\s*)*)(pub(?:\([^)]*\))?\s+)?\b(struct|enum|trait|union)\s+([A-Za-z_]\w*)\s*(<[^{;(]*>)?\s*(:\s*[^{;]+)?")
_RUST_FUNCTION = re.compile(r"((?:#\[[^\]]*\]\s*)*)(pub(?:\([^)]*\))?\s+)?((?:(?:default|const|async|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*)fn\s+([A-Za-z_]\w*)\s*(?:<[^(]*>)?\s*\(")
_RUST_IMPL = re.compile(r"\bimpl\b\s*(?:<[^{]*?>)?\s*(?:(!?[\w:]+(?:<[^{]*?>)?)\s+for\s+)?([\w:]+)[^{;]*\{")


def _rust_functions(t: Text, start: int, end: int, method: bool) -> list[dict]:
    found, at = [], start
    while m := _RUST_FUNCTION.search(t.code, at, end):
        open_list = m.end() - 1
        body, between = _body(t, t.close(open_list, "()") + 1, end)
        marks = [x.strip() for x in re.findall(r"#\[([^\]]*)\]", m[1])] + (["pub"] if m[2] else []) + [w for w in ("const", "unsafe") if w in m[3].split()]
        returns = re.sub(r"\bwhere\b.*", "", between, flags=re.S).removeprefix("->").strip()
        taken = t.source[open_list + 1 : t.close(open_list, "()")]
        found.append(_made(t, m[4], m.start(4), open_list, body, return_type=returns or None, decorators=marks, is_async="async" in m[3].split(), is_method=method, is_static=method and not re.match(r"\s*&?\s*(?:'\w+\s+)?(?:mut\s+)?self\b", taken)))
        at = (t.close(body) if body is not None else m.end()) + 1
    return found


def _rust_uses(t: Text) -> Iterator[dict]:
    for m in re.finditer(r"\buse\s+([^;]+);", t.code):
        text, line = re.sub(r"\s+", " ", m[1]).strip(), t.line(m.start())
        head, brace, rest = text.partition("{")
        if brace:
            names = [re.split(r"\s+as\s+", n)[0] for n in _split(rest.rpartition("}")[0])]
            yield _import(head.rstrip(":"), line, names=names, is_from=True)
        else:
            path, _, alias = text.partition(" as ")
            base, _, last = path.rpartition("::")
            yield _import(base or path, line, names=[last] if base else [], alias=alias or None, is_from=bool(base))
    for m in re.finditer(r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", t.code, re.M):
        yield _import(m[1], t.line(m.start(1)))


def _rust(t: Text) -> dict:
    classes, spans = {}, []
    for m in _RUST_TYPE.finditer(t.code):
        after = re.compile(r"\s*(?:where[^{;]*)?([{;(])").match(t.code, m.end())
        end = t.close(after.end() - 1, "{}" if after[1] == "{" else "()") if after and after[1] != ";" else m.end()
        inside = t.code[after.end() : end] if after and after[1] == "{" else ""
        parts = [re.sub(r"^(?:#\[[^\]]*\]\s*)+", "", p).strip() for p in _split(inside)]
        attributes = [x[1] for p in parts if (x := re.match(r"(?:pub(?:\([^)]*\))?\s+)?([A-Za-z_]\w*)", p))] if m[3] in ("struct", "enum") else []
        marks = [m[3]] + [x.strip() for x in re.findall(r"#\[([^\]]*)\]", m[1])] + (["pub"] if m[2] else [])
        methods = _rust_functions(t, after.end(), end, True) if m[3] == "trait" and after else []
        bases = [b.strip() for b in (m[6] or "").lstrip(": ").split("+") if b.strip()]
        if after and after[1] == "{":
            spans.append((m.start(), end))
        classes[m[4]] = _class(m[4], "rust", bases=bases, decorators=marks, methods=methods, attributes=attributes, start_line=t.line(m.start(3)), end_line=t.line(end))
    for m in _RUST_IMPL.finditer(t.code):
        end = t.close(m.end() - 1)
        spans.append((m.start(), end))
        name, trait = m[2].rpartition("::")[2], re.sub(r"<.*", "", m[1] or "").rpartition("::")[2]
        own = classes.get(name) or _class(name, "rust", decorators=["impl"], start_line=t.line(m.start()), end_line=t.line(end))
        bases = own["bases"] + ([trait] if trait and trait not in own["bases"] else [])
        classes[name] = _class(name, "rust", **{k: v for k, v in own.items() if k not in ("name", "referenced_types", "methods", "bases")}, bases=bases, methods=own["methods"] + _rust_functions(t, m.end(), end, True))
    free, at = [], 0
    for a, b in sorted(spans) + [(len(t.code), len(t.code))]:
        if a >= at:
            free += _rust_functions(t, at, a, False)
        at = max(at, b + 1)
    return {"imports": list(_rust_uses(t)), "classes": list(classes.values()), "functions": free}


_PARSERS = {"typescript": _typescript, "javascript": _typescript, "go": _go, "java": _java, "rust": _rust, "csharp": _csharp}


def parse(path: str, source: str | None, language: str | None) -> dict:
    """The module of a file; ``error`` says why there is none."""
    language, source = _ALIASES.get((language or "").lower(), (language or "").lower()), source or ""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    base = {"name": stem, "path": path, "language": language, "imports": [], "classes": [], "functions": [], "module_docstring": None, "total_lines": len(source.splitlines()), "namespace": None, "error": None}
    try:
        if language == "python":
            return base | _python(path, source)
        if language in _PARSERS:
            found = _PARSERS[language](Text(source, language))
            return base | found | {"name": found.get("name") or stem}
        return base | {"error": f"unsupported language: {language}"}
    except (SyntaxError, ValueError, RecursionError) as e:
        return base | {"error": f"{type(e).__name__}: {e}"}


def parse_json(path: str, source: str | None, language: str | None) -> str:
    return json.dumps(parse(path, source, language))
