"""Cells that hold a Python literal, such as a dict with single quotes, ``None`` and whole numbers as keys, as JSON and VARIANT.

A lexer in column expressions: the cell is taken apart into tokens, each token is written as JSON, and the pieces are joined. So an apostrophe inside a name, a quotation
mark inside single quotes or the word ``None`` inside a text stay what they are, which no replacement of quotes in the whole cell can tell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings of either quote, numbers also as NumPy prints them, names, and the signs of containers
TOKEN = (
    r"""'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|(?:np\.|numpy\.)?[a-z_]+[0-9]*\([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?\)|[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|[A-Za-z_][A-Za-z_0-9]*|[{}\[\](),:]|\s+"""
)
#: Stands for an escaped backslash while the other escapes are rewritten; no text holds it
MARK = "￿"
# Names of a literal and what JSON has for them
NAMES = {"None": "null", "nan": "null", "True": "true", "False": "false"}
BRACKETS = {"(": "[", ")": "]"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once a row however often the body names it; a column named inside a lambda would be worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _string(token: Column) -> Column:
    """A string token between double quotes, with the escapes of JSON."""
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    body = F.replace(plain, F.lit("\\\\"), F.lit(MARK))
    body = F.replace(F.replace(body, F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"'))
    body = F.replace(body, F.lit('"'), F.lit('\\"'))
    body = F.regexp_replace(body, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    body = F.replace(F.replace(body, F.lit("\\a"), F.lit("\\u0007")), F.lit("\\v"), F.lit("\\u000b"))
    body = F.regexp_replace(body, r'\\([^nrtbfu"])', MARK + "$1")  # any other escape is the two characters themselves
    body = F.replace(F.replace(body, F.lit("\t"), F.lit("\\t")), F.lit(MARK), F.lit("\\\\"))
    return F.concat(F.lit('"'), F.when(plain.rlike(r'[\\"\t]'), body).otherwise(plain), F.lit('"'))


def _number(token: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(token, r"^.*\(|\)$", ""), r"^\+", "")
    return F.regexp_replace(F.regexp_replace(plain, r"^(-?)\.", "$10."), r"\.(?=$|[eE])", ".0")


def literal_json(cell: Column) -> Column:
    """The JSON of a cell's literal; null where the cell is null or no literal of strings, numbers, ``True``, ``False``, ``None``, dicts, lists and tuples.

    Tuples become arrays; keys that are numbers or names become strings as Python writes them; a comma before a closing bracket goes. NumPy's ``np.float64(1.5)`` is its number.
    JSON is taken as it is. Sets, bytes, and strings with prefixes or in three quotes are null. A repeated key makes a cell null.
    """
    quotes, signs = ("'", '"'), tuple("{}[](),:")
    words = [F.lit(x) for pair in (NAMES | BRACKETS).items() for x in pair]

    def written(t: Column, after: Column) -> Column:
        first = F.substring(t, 1, 1)
        named = F.coalesce(F.element_at(F.create_map(*words), t), t)
        value = F.when(first.isin(*quotes), _string(t)).when(F.length(t) == 1, named).when(t.rlike(r"^[-+.0-9]|\("), _number(t)).otherwise(named)
        key = (after == ":") & ~first.isin(*quotes, *signs)
        drop = (t == ",") & after.isin("}", "]", ")")
        return F.when(drop, "").when(key, F.concat(F.lit('"'), F.regexp_replace(t, r"^.*\(|\)$", ""), F.lit('"'))).otherwise(value)

    def of_tokens(all_tokens: Column) -> Column:
        joined = let(F.filter(all_tokens, lambda t: ~t.rlike(r"^\s")), lambda tokens: F.array_join(F.transform(tokens, lambda t, i: written(t, F.coalesce(F.get(tokens, i + 1), F.lit("")))), ""))
        single = lambda j: F.json_array_length(F.concat(F.lit("["), j, F.lit("]"))) == 1  # noqa: E731 a parser stops at the end of the first value, whatever follows
        sound = let(joined, lambda j: F.when(single(j) & F.try_parse_json(j).isNotNull(), j))
        return F.when(F.array_join(all_tokens, "") == cell, sound)

    return let(F.regexp_extract_all(cell, F.lit(f"({TOKEN})"), 1), of_tokens)


def literal_variant(cell: Column) -> Column:
    """The same as VARIANT, whose parts ``variant_get`` and ``try_variant_get`` take out by path and type."""
    return F.try_parse_json(literal_json(cell))


def json_map(json: Column) -> Column:
    """The map of :func:`literal_map` where the JSON is known already."""
    return F.when(json.startswith("{"), F.from_json(json, "map<string,string>"))


def literal_map(cell: Column) -> Column:
    """A dict's keys with their values as text, nested ones as JSON; null for anything but a dict."""
    return let(literal_json(cell), json_map)
