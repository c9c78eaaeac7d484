"""The dialect's scalar functions as Spark SQL expressions.

``CALLS`` has a builder per name: it gets the emitter and the typed arguments and returns a
typed expression. What built-in functions cannot say is left to the Python functions in
``PYTHON``, which are registered when a statement first needs them.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from quern.dialect.emit import Emitter, Typed, string
from quern.dialect.parser import Node, SqlError
from quern.functions import dates
from quern.functions.glob import glob_regex

Build = Callable[[Emitter, list[Typed], Node], Typed]
CALLS: dict[str, tuple[Build, int, int]] = {}
#: name -> (module, function, Spark type of the result, deterministic)
PYTHON: dict[str, tuple[str, str, str, bool]] = {
    "quern_words": ("quern.operators.fts", "words", "array<string>", True),
    "quern_words_matched": ("quern.operators.fts", "matched", "int", True),
    "quern_glob": ("quern.functions.glob", "glob_match", "boolean", True),
    "quern_char": ("quern.functions.glob", "characters", "string", True),
    "quern_randomblob": ("os", "urandom", "binary", False),
    "quern_json": ("quern.functions.json_values", "minify", "string", True),
    "quern_json_or_null": ("quern.functions.json_values", "minify_or_none", "string", True),
    "quern_json_extract": ("quern.functions.json_values", "extract_many", "string", True),
    "quern_json_arrow": ("quern.functions.json_values", "arrow", "string", True),
    "quern_json_edit": ("quern.functions.json_values", "edit", "string", True),
    "quern_json_remove": ("quern.functions.json_values", "remove", "string", True),
    "quern_json_patch": ("quern.functions.json_values", "patch", "string", True),
}
BLANK = r"[\\p{IsWhite_Space}]+"


def function(names: str, least: int = 1, most: int | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        for name in names.split():
            CALLS[name] = (build, least, least if most is None else most)
        return build

    return add


def call(e: Emitter, node: Node) -> Typed | None:
    """The typed expression, or None for a name that is not built in."""
    if node.name not in CALLS:
        return None
    build, least, most = CALLS[node.name]
    if not least <= len(node.args) <= most:
        raise SqlError(f"wrong number of arguments to function {node.name}()")
    return build(e, [e.value(e.expr(a)) for a in node.args], node)


def propagate(e: Emitter, args: list[Typed], sql: str) -> str:
    return f"(CASE WHEN {' OR '.join(f'{s} IS NULL' for s, _ in args)} THEN NULL ELSE {sql} END)"


@function("LENGTH")
def length(e: Emitter, a: list[Typed], n: Node) -> Typed:
    s, k = a[0]
    if k == "vector":
        return f"CAST(size({s}) * 4 AS BIGINT)", "int"
    return (f"CAST(octet_length({s}) AS BIGINT)" if k == "blob" else f"CAST(char_length({e.text(a[0])}) AS BIGINT)"), "int"


@function("UPPER LOWER")
def fold(e: Emitter, a: list[Typed], n: Node) -> Typed:
    return f"{n.name.lower()}({e.text(a[0])})", "text"


@function("SUBSTR SUBSTRING", 2, 3)
def substr(e: Emitter, a: list[Typed], n: Node) -> Typed:
    blob = a[0][1] == "blob"
    s = a[0][0] if blob else e.text(a[0])
    size = f"{'octet_length' if blob else 'char_length'}({s})"
    i = e.whole(a[1])
    start = f"(CASE WHEN {i} > 0 THEN {i} WHEN {i} < 0 THEN greatest({size} + {i} + 1L, 1L) ELSE 1L END)"
    if len(a) == 2:
        take = f"{size}"
    else:
        m = e.whole(a[2])
        take = f"(CASE WHEN {m} < 0 THEN CAST({size} AS BIGINT) WHEN {i} = 0 THEN greatest({m} - 1L, 0L) ELSE {m} END)"
    return f"substr({s}, CAST({start} AS INT), CAST(least({take}, 2147483647L) AS INT))", "blob" if blob else "text"


@function("REPLACE", 3)
def replace(e: Emitter, a: list[Typed], n: Node) -> Typed:
    s, old, new = map(e.text, a)
    everywhere = f"concat({new}, array_join(transform(split({s}, ''), x -> concat(x, {new})), ''))"
    return propagate(e, a, f"CASE WHEN {old} = '' THEN IF({s} = '', {new}, {everywhere}) ELSE replace({s}, {old}, {new}) END"), "text"


@function("INSTR", 2)
def instr(e: Emitter, a: list[Typed], n: Node) -> Typed:
    return f"CAST(instr({e.text(a[0])}, {e.text(a[1])}) AS BIGINT)", "int"


@function("TRIM LTRIM RTRIM", 1, 2)
def trim(e: Emitter, a: list[Typed], n: Node) -> Typed:
    s = e.text(a[0])
    if n.name != "RTRIM":
        s = f"regexp_replace({s}, '^{BLANK}', '')"
    return (f"regexp_replace({s}, '{BLANK}\\\\z', '')" if n.name != "LTRIM" else s), "text"


@function("HEX")
def hex_(e: Emitter, a: list[Typed], n: Node) -> Typed:
    return f"coalesce(hex({a[0][0] if a[0][1] == 'blob' else e.text(a[0])}), '')", "text"


@function("QUOTE")
def quote_(e: Emitter, a: list[Typed], n: Node) -> Typed:
    s, k = a[0]
    if k in ("int", "real", "null"):
        return f"coalesce({e.text(a[0])}, 'NULL')", "text"
    body = f"concat('X\\'', hex({s}), '\\'')" if k == "blob" else f"concat('\\'', replace({s}, '\\'', '\\'\\''), '\\'')"
    return f"coalesce({body}, 'NULL')", "text"


@function("UNICODE")
def unicode_(e: Emitter, a: list[Typed], n: Node) -> Typed:
    s = e.text(a[0])
    return f"IF({s} = '', NULL, CAST(ascii({s}) AS BIGINT))", "int"


@function("CHAR", 0, 99)
def char(e: Emitter, a: list[Typed], n: Node) -> Typed:
    if all(x.kind == "literal" and isinstance(x.value, int) for x in n.args):
        return string("".join(chr(x.value) for x in n.args)), "text"
    e.host.need("quern_char")
    return f"quern_char({', '.join(e.whole(x) for x in a)})", "text"


@function("ZEROBLOB")
def zeroblob(e: Emitter, a: list[Typed], n: Node) -> Typed:
    return f"unhex(repeat('00', CAST(greatest({e.whole(a[0])}, 0L) AS INT)))", "blob"


@function("RANDOMBLOB")
def randomblob(e: Emitter, a: list[Typed], n: Node) -> Typed:
    e.host.need("quern_randomblob")
    return f"quern_randomblob(greatest({e.whole(a[0])}, 1L))", "blob"


@function("GLOB", 2)
def glob(e: Emitter, a: list[Typed], n: Node) -> Typed:
    return glob_sql(e.host, e.text(a[1]), e.constant(n.args[0]), e.text(a[0])), "bool"


def glob_sql(host: Any, value: str, constant: Any, pattern: str) -> str:
    if constant is not None:
        return f"({value} RLIKE {string(glob_regex(str(constant)))})"
    host.need("quern_glob")
    return f"quern_glob({pattern}, {value})"


@function("PRINTF FORMAT", 1, 99)
def printf(e: Emitter, a: list[Typed], n: Node) -> Typed:
    form = e.constant(n.args[0])
    if form is None:
        raise SqlError(f"{n.name} needs a constant format")
    parts, rest, i, form = [], list(a[1:]), 0, str(form)
    while i < len(form):
        c = form[i + 1 : i + 2]
        if form[i] == "%" and c in ("d", "i", "f", "s"):
            arg = rest.pop(0) if rest else ("NULL", "null")
            s, _ = e.number(arg)
            parts.append({"d": f"coalesce(CAST(CAST({s} AS BIGINT) AS STRING), '0')", "f": f"format_string('%.6f', coalesce(CAST({s} AS DOUBLE), 0.0D))"}.get("d" if c == "i" else c) or f"coalesce({e.text(arg)}, '')")
            i += 2
        elif form[i] == "%" and c == "%":
            parts.append("'%'")
            i += 2
        else:
            end = form.find("%", i + 1)
            end = end if end > 0 else len(form)
            parts.append(string(form[i:end]))
            i = end
    return f"concat({', '.join(parts)})" if parts else "''", "text"


@function("ABS")
def abs_(e: Emitter, a: list[Typed], n: Node) -> Typed:
    s, k = e.number(a[0])
    return f"abs({s})", k


@function("ROUND", 1, 2)
def round_(e: Emitter, a: list[Typed], n: Node) -> Typed:
    s = f"CAST({e.number(a[0])[0]} AS DOUBLE)"
    if len(a) == 1:
        return f"(sign({s}) * floor(abs({s}) + 0.5D))", "real"
    scale = f"pow(10.0D, {e.number(a[1])[0]})"
    return f"(sign({s}) * floor(abs({s} * {scale}) + 0.5D) / {scale})", "real"


@function("SIGN")
def sign(e: Emitter, a: list[Typed], n: Node) -> Typed:
    s = f"TRY_CAST({a[0][0]} AS DOUBLE)" if a[0][1] in ("text", "json") else e.number(a[0])[0]
    return f"CAST(sign({s}) AS BIGINT)", "int"


@function("RANDOM", 0)
def random(e: Emitter, a: list[Typed], n: Node) -> Typed:
    return "(CAST(rand() * 9007199254740992D AS BIGINT) * 1024L + CAST(rand() * 1024 AS BIGINT))", "int"


@function("MIN MAX", 2, 99)
def extreme(e: Emitter, a: list[Typed], n: Node) -> Typed:
    many, kind = e.common(a)
    best = f"{'least' if n.name == 'MIN' else 'greatest'}({', '.join(many)})"
    # a null behind the first makes the result null; a null first one does so for MIN only
    nulls = many if n.name == "MIN" else many[1:]
    return f"(CASE WHEN {' OR '.join(f'{s} IS NULL' for s in nulls)} THEN NULL ELSE {best} END)", kind


@function("__SHL __SHR", 2)
def shift(e: Emitter, a: list[Typed], n: Node) -> Typed:
    return f"{'shiftleft' if n.name == '__SHL' else 'shiftrightunsigned'}({e.whole(a[0])}, CAST({e.whole(a[1])} & 63L AS INT))", "int"


@function("__BNOT")
def bnot(e: Emitter, a: list[Typed], n: Node) -> Typed:
    return f"(~ {e.whole(a[0])})", "int"


@function("COALESCE IFNULL", 2, 99)
def coalesce(e: Emitter, a: list[Typed], n: Node) -> Typed:
    many, kind = e.common(a)
    return f"coalesce({', '.join(many)})", kind


@function("NULLIF", 2)
def nullif(e: Emitter, a: list[Typed], n: Node) -> Typed:
    return f"(CASE WHEN {e.compared('=', a[0], a[1])[0]} THEN NULL ELSE {a[0][0]} END)", a[0][1]


@function("IIF", 3)
def iif(e: Emitter, a: list[Typed], n: Node) -> Typed:
    (x, y), kind = e.common(a[1:])
    return f"if({e.cond(n.args[0])}, {x}, {y})", kind


@function("TYPEOF")
def typeof(e: Emitter, a: list[Typed], n: Node) -> Typed:
    s, k = a[0]
    name = {"int": "integer", "real": "real", "blob": "blob", "vector": "blob", "null": "null"}.get(k, "text")
    return ("'null'" if k == "null" else f"if({s} IS NULL, 'null', '{name}')"), "text"


@function("LIKELY UNLIKELY LIKELIHOOD", 1, 2)
def likely(e: Emitter, a: list[Typed], n: Node) -> Typed:
    return a[0]


@function("IS_TRUE IS_FALSE IS_NOT_TRUE IS_NOT_FALSE")
def is_truth(e: Emitter, a: list[Typed], n: Node) -> Typed:
    return e.on_truth(Node("truth", arg=n.args[0], value=n.name.endswith("TRUE"), negated="NOT" in n.name))


def moment(e: Emitter, a: list[Typed], n: Node, skip: int = 0) -> str:
    args, nodes = a[skip:], n.args[skip:]
    t = dates.moment(*args[0]) if args else dates.moment("'now'", "text")
    for node in nodes[1:]:
        m = e.constant(node)
        if not isinstance(m, str):
            raise SqlError("date modifiers must be constant texts")
        t = dates.modified(t, m)
    return t


@function("DATE TIME DATETIME", 0, 99)
def date(e: Emitter, a: list[Typed], n: Node) -> Typed:
    form = {"DATE": "yyyy-MM-dd", "TIME": "HH:mm:ss", "DATETIME": "yyyy-MM-dd HH:mm:ss"}[n.name]
    return f"date_format({moment(e, a, n)}, '{form}')", "text"


@function("JULIANDAY UNIXEPOCH", 0, 99)
def since(e: Emitter, a: list[Typed], n: Node) -> Typed:
    t = moment(e, a, n)
    return (dates.julian(t), "real") if n.name == "JULIANDAY" else (dates.unix(t), "int")


@function("STRFTIME", 1, 99)
def strftime(e: Emitter, a: list[Typed], n: Node) -> Typed:
    form = e.constant(n.args[0])
    if form is None:
        raise SqlError("STRFTIME needs a constant format")
    return dates.strftime(str(form), moment(e, a, n, 1)), "text"


# JSON


def to_json_value(e: Emitter, x: Typed) -> str:
    """A value as JSON text; a text is a JSON string."""
    s, k = e.value(x)
    if k == "null":
        return "'null'"
    if k in ("int", "real"):
        return f"coalesce({e.text((s, k))}, 'null')"
    written = f"to_json(named_struct('v', {s}))"  # {"v":"..."}
    return f"IF({s} IS NULL, 'null', substring({written}, 6, length({written}) - 6))"


def embedded(e: Emitter, x: Typed) -> str:
    """A value as JSON text; a text that is JSON is embedded as it is."""
    s, k = e.value(x)
    if k not in ("text", "json"):
        return to_json_value(e, x)
    e.host.need("quern_json_or_null")
    return f"coalesce(quern_json_or_null({s}), {to_json_value(e, x)})"


def unpacked(variant: str) -> str:
    """A variant as an SQL value's text: Booleans are 0 or 1, whole numbers have no fraction."""
    return f"(CASE WHEN schema_of_variant({variant}) = 'BOOLEAN' THEN IF(CAST({variant} AS BOOLEAN), '1', '0') WHEN schema_of_variant({variant}) = 'VOID' THEN NULL WHEN schema_of_variant({variant}) RLIKE '^(ARRAY|OBJECT)' THEN to_json({variant}) ELSE CAST({variant} AS STRING) END)"


@function("JSON")
def json(e: Emitter, a: list[Typed], n: Node) -> Typed:
    e.host.need("quern_json")
    return f"quern_json({e.text(a[0])})", "text"


@function("JSON_EXTRACT", 2, 99)
def json_extract(e: Emitter, a: list[Typed], n: Node) -> Typed:
    if len(a) == 2:
        return unpacked(f"try_variant_get(try_parse_json({e.text(a[0])}), {e.text(a[1])}, 'variant')"), "json"
    e.host.need("quern_json_extract")
    return f"quern_json_extract({', '.join(map(e.text, a))})", "text"


@function("JSON_TYPE", 1, 2)
def json_type(e: Emitter, a: list[Typed], n: Node) -> Typed:
    v = f"try_parse_json({e.text(a[0])})"
    if len(a) == 2:
        v = f"try_variant_get({v}, {e.text(a[1])}, 'variant')"
    kind = f"schema_of_variant({v})"
    return f"(CASE WHEN {v} IS NULL THEN NULL WHEN {kind} = 'VOID' THEN 'null' WHEN {kind} = 'BOOLEAN' THEN CAST(CAST({v} AS BOOLEAN) AS STRING) WHEN {kind} = 'STRING' THEN 'text' WHEN {kind} LIKE 'ARRAY%' THEN 'array' WHEN {kind} LIKE 'OBJECT%' THEN 'object' ELSE 'real' END)", "text"


@function("JSON_VALID")
def json_valid(e: Emitter, a: list[Typed], n: Node) -> Typed:
    return ("0L" if a[0][1] not in ("text", "json") else f"CAST(try_parse_json({a[0][0]}) IS NOT NULL AS BIGINT)"), "int"


@function("JSON_ARRAY", 0, 99)
def json_array(e: Emitter, a: list[Typed], n: Node) -> Typed:
    return f"concat('[', concat_ws(','{''.join(', ' + embedded(e, x) for x in a)}), ']')", "text"


@function("JSON_OBJECT", 0, 99)
def json_object(e: Emitter, a: list[Typed], n: Node) -> Typed:
    pairs = "".join(f", concat({to_json_value(e, (e.text(k), 'text'))}, ':', {embedded(e, v)})" for k, v in zip(a[::2], a[1::2]))
    return f"concat('{{', concat_ws(','{pairs}), '}}')", "text"


@function("JSON_ARRAY_LENGTH", 1, 2)
def json_array_length(e: Emitter, a: list[Typed], n: Node) -> Typed:
    v = f"try_parse_json({e.text(a[0])})"
    if len(a) == 2:
        v = f"try_variant_get({v}, {e.text(a[1])}, 'variant')"
    return f"(CASE WHEN {v} IS NOT NULL THEN CAST(coalesce(json_array_length(to_json({v})), 0) AS BIGINT) END)", "int"


@function("JSON_QUOTE")
def json_quote(e: Emitter, a: list[Typed], n: Node) -> Typed:
    return to_json_value(e, a[0]), "text"


@function("JSON_INSERT JSON_REPLACE JSON_SET", 3, 99)
def json_edit(e: Emitter, a: list[Typed], n: Node) -> Typed:
    e.host.need("quern_json_edit")
    pairs = "".join(f", {e.text(p)}, {e.text(v)}, '{v[1]}'" for p, v in zip(a[1::2], a[2::2]))
    return f"quern_json_edit('{n.name[5:].lower()}', {e.text(a[0])}{pairs})", "text"


@function("JSON_REMOVE", 1, 99)
def json_remove(e: Emitter, a: list[Typed], n: Node) -> Typed:
    e.host.need("quern_json_remove")
    return f"quern_json_remove({', '.join(map(e.text, a))})", "text"


@function("JSON_PATCH", 2)
def json_patch(e: Emitter, a: list[Typed], n: Node) -> Typed:
    e.host.need("quern_json_patch")
    return f"quern_json_patch({e.text(a[0])}, {e.text(a[1])})", "text"


# vectors


def vector(e: Emitter, x: Typed) -> str:
    s, k = x
    if k == "blob":  # little-endian 32-bit floats
        at = f"substr(hex({s}), CAST(i * 8 + 1 AS INT), 8)"
        bits = f"conv(concat(substr({at}, 7, 2), substr({at}, 5, 2), substr({at}, 3, 2), substr({at}, 1, 2)), 16, 10)"
        n = f"CAST({bits} AS BIGINT)"
        power = f"(shiftright({n}, 23) & 255L)"
        value = f"IF({n} >= 2147483648L, -1D, 1D) * IF({power} = 0L, ({n} & 8388607L) * pow(2D, -149D), (({n} & 8388607L) + 8388608L) * pow(2D, CAST({power} - 150L AS DOUBLE)))"
        return f"(CASE WHEN octet_length({s}) % 4 <> 0 THEN raise_error('a vector has four bytes a number') WHEN octet_length({s}) = 0 THEN CAST(ARRAY() AS ARRAY<DOUBLE>) ELSE transform(sequence(0L, octet_length({s}) DIV 4 - 1L), i -> {value}) END)"
    if k == "vector":
        return s
    raise SqlError("a vector function needs a vector")


def same_size(a: str, b: str, sql: str) -> str:
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN raise_error('a vector is null') WHEN size({a}) <> size({b}) THEN raise_error('vectors differ in dimensions') ELSE {sql} END)"


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"


def vector_functions() -> dict[str, str]:
    """name -> statement of the SQL functions for distances; as functions, they also take scalar subqueries."""
    norms = f"(sqrt({dot('a', 'a')}) * sqrt({dot('b', 'b')}))"
    bodies = {
        "quern_vec_l2": "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
        "quern_vec_dot": f"(- {dot('a', 'b')})",
        "quern_vec_cosine": f"(CASE WHEN {norms} = 0 THEN 1D ELSE 1D - {dot('a', 'b')} / {norms} END)",
    }
    return {n: f"CREATE OR REPLACE TEMPORARY FUNCTION {n}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {same_size('a', 'b', body)}" for n, body in bodies.items()}


@function("VEC_DISTANCE_COSINE VEC_DISTANCE_L2 VEC_DISTANCE_DOT", 2)
def distance(e: Emitter, a: list[Typed], n: Node) -> Typed:
    name = "quern_vec_" + n.name[13:].lower()
    e.host.need(name)
    return f"{name}(CAST({vector(e, a[0])} AS ARRAY<DOUBLE>), CAST({vector(e, a[1])} AS ARRAY<DOUBLE>))", "real"


@function("VEC_LENGTH")
def vec_length(e: Emitter, a: list[Typed], n: Node) -> Typed:
    return f"CAST(size({vector(e, a[0])}) AS BIGINT)", "int"


@function("VEC_NORMALIZE")
def vec_normalize(e: Emitter, a: list[Typed], n: Node) -> Typed:
    x = vector(e, a[0])
    norm = f"sqrt({dot(x, x)})"
    return f"CAST(IF({norm} = 0, {x}, transform({x}, v -> CAST(v / {norm} AS FLOAT))) AS ARRAY<FLOAT>)", "vector"


@function("VEC_FROM_JSON")
def vec_from_json(e: Emitter, a: list[Typed], n: Node) -> Typed:
    return f"from_json({e.text(a[0])}, 'array<float>')", "vector"


@function("VEC_TO_JSON")
def vec_to_json(e: Emitter, a: list[Typed], n: Node) -> Typed:
    return f"to_json({vector(e, a[0])})", "text"


# session


@function("LAST_INSERT_ROWID CHANGES TOTAL_CHANGES", 0)
def session(e: Emitter, a: list[Typed], n: Node) -> Typed:
    return f"{e.host.state[n.name.lower()]}L", "int"


@function("SQLITE_VERSION SQLITE_SOURCE_ID", 0)
def version(e: Emitter, a: list[Typed], n: Node) -> Typed:
    return ("'3.46.0'" if n.name.endswith("VERSION") else "'quern'"), "text"


def tokens(e: Emitter, text: str) -> str:
    """A text's search tokens as an array, those of full-text tables."""
    from quern.operators import fts

    e.host.need("quern_words")
    own = f"coalesce({text}, '')"
    return f"IF(octet_length({own}) = char_length({own}), {fts.plain_tokens(own)}, quern_words({own}))"


def matched_share(e: Emitter, a: list[Typed], n: Node) -> tuple[str, str]:
    """How many of a query's tokens a text has, and how many there are."""
    from quern.operators import fts

    query = e.constant(n.args[1])
    if query is None:
        e.host.need("quern_words_matched")
        e.host.need("quern_words")
        return f"quern_words_matched(coalesce({e.text(a[0])}, ''), coalesce({e.text(a[1])}, ''))", f"size(quern_words(coalesce({e.text(a[1])}, '')))"
    words, text = fts.query_tokens(str(query)), tokens(e, e.text(a[0]))
    return " + ".join([f"int(array_contains({text}, '{w}'))" for w in words] or ["0"]), str(len(words))


@function("FTS5_MATCH", 2)
def fts5_match(e: Emitter, a: list[Typed], n: Node) -> Typed:
    matched, total = matched_share(e, a, n)
    return f"CAST({a[0][0]} IS NOT NULL AND ({matched}) = {total} AS BIGINT)", "int"


@function("FTS5_RANK", 2)
def fts5_rank(e: Emitter, a: list[Typed], n: Node) -> Typed:
    matched, total = matched_share(e, a, n)
    return f"(CASE WHEN {total} = 0 THEN 0D ELSE CAST({matched} AS DOUBLE) / {total} END)", "real"


@function("__FTS5_RANK_TOKEN", 2)
def fts5_rank_token(e: Emitter, a: list[Typed], n: Node) -> Typed:
    name, query = e.constant(n.args[0]), e.constant(n.args[1])
    for r in e.scope.relations if e.scope else []:
        if r.fts and str(name).lower() in (r.fts.name.lower(), r.alias.lower()):
            view = e.host.fts_scores(r.fts, str(query))
            return f"coalesce((SELECT max(__s.score) FROM {view} AS __s WHERE __s.rowid = {r.ref('__rowid__')}), 0D)", "real"
    raise SqlError(f"no such full-text table: {name}")
