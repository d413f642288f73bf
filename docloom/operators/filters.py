"""Filter expressions of vector stores as Columns.

Such an expression is spelled a little differently from Spark's SQL: ``in`` takes a
list in brackets, strings may stand in double quotes, and a field of the metadata is
``metadata['field']``.  Only its tokens are respelled here; Spark parses it, so that
what it makes of it reaches the scan like any other filter.  Tokens that aren't
columns, literals or operators, such as calls, are errors.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|<>|<=|>=|<|>|=|&&|\|\||[()\[\],]))""")
#: Words of the expressions, as Spark spells them.
_WORDS = {w: w for w in ("and", "or", "not", "in", "like", "is", "null", "between", "true", "false")}
_MARKS = {"&&": "and", "||": "or"}


def _literal(text: str) -> str:
    body = re.sub(r"\\(.)", r"\1", text[1:-1])
    return "'" + body.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no filter expression: {text!r}, at {text[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def boolean_filter(text: str, columns: Collection[str], metadata: str = "metadata", kind: str = "json") -> Column:
    """The Column of an expression on ``columns``; a field of ``metadata`` is compared as text, or as a number beside one.

    ``kind`` says how metadata are kept: ``json`` (a string), ``variant`` or ``map``.
    """
    found, out, i = tokens(text), [], 0
    if not found:
        raise ValueError("an empty filter expression")
    while i < len(found):
        of, token = found[i]
        if of == "string":
            out.append(_literal(token))
        elif of == "number":
            out.append(token)
        elif of == "name" and token == metadata and [t for _, t in found[i + 1 : i + 2]] == ["["]:
            if len(found) < i + 4 or found[i + 2][0] != "string" or found[i + 3][1] != "]":
                raise ValueError(f"a field of {metadata} is written {metadata}['field']: {text!r}")
            number = any(g == "number" for g, _ in found[i + 4 : i + 7] + found[max(0, i - 2) : i])
            out.append(_field(metadata, found[i + 2][1][1:-1], kind, "double" if number else "string"))
            i += 3
        elif of == "name" and token.lower() in _WORDS:
            out.append(_WORDS[token.lower()])
        elif of == "name" and token in columns:
            if [t for _, t in found[i + 1 : i + 2]] == ["("]:
                raise ValueError(f"calls aren't part of filter expressions: {text!r}")
            out.append(f"`{token}`")
        elif of == "mark":
            out.append({"[": "(", "]": ")", **_MARKS}.get(token, token))
        else:
            raise ValueError(f"unknown column {token!r} in the filter expression {text!r}")
        i += 1
    try:
        return F.expr(" ".join(out))
    except Exception as e:
        raise ValueError(f"no filter expression: {text!r}") from e


def _field(metadata: str, field: str, kind: str, of: str) -> str:
    if not re.fullmatch(r"\w[\w .-]*", field):
        raise ValueError(f"no name of a metadata field: {field!r}")
    if kind == "variant":
        return f"try_variant_get(`{metadata}`, '$[\"{field}\"]', '{of}')"
    if kind == "map":
        return f"cast(`{metadata}`['{field}'] as {of})"
    return f"cast(get_json_object(`{metadata}`, '$.{field}') as {of})" if re.fullmatch(r"\w+", field) else f"cast(get_json_object(`{metadata}`, \"$['{field}']\") as {of})"
