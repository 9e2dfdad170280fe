"""Python dict literals in text columns, read and written with column expressions.

A literal is cut into tokens (strings, numbers, names, punctuation) by one pattern; each token becomes its JSON form, and
the joined JSON is parsed.  What is not a dict literal is the empty map.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRING = r"""'(?:[^'\\]|\\[\s\S])*'|"(?:[^"\\]|\\[\s\S])*\""""
#: Strings; numbers and names; anything else by the character (white space apart).
TOKEN = "(" + STRING + r"|[A-Za-z0-9_.+-]+|[^\s])"
UNIT = r"(\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\[\s\S]|[^\\]+)"


def _json_string(token: Column) -> Column:
    """A quoted token as a JSON string: its escapes are those of JSON or are written anew."""
    inside = F.substr(token, F.lit(2), F.length(token) - 2)

    def unit(u: Column) -> Column:
        plain = F.replace(F.replace(F.replace(F.replace(u, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
        return (F.when(~F.startswith(u, F.lit("\\")), plain).when(u == "\\'", "'").when(F.startswith(u, F.lit("\\x")), F.concat(F.lit("\\u00"), F.substr(u, F.lit(3))))
                .when(u.rlike(r'^\\["\\/bfnrt]$') | F.startswith(u, F.lit("\\u")), u).otherwise(F.concat(F.lit("\\"), u)))

    return F.concat(F.lit('"'), F.array_join(F.transform(F.regexp_extract_all(inside, F.lit(UNIT), F.lit(1)), unit), ""), F.lit('"'))


def literal_to_json(text: Column) -> Column:
    """JSON text of a Python literal of dicts, lists, tuples, strings, numbers, True, False and None."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))

    def json(t: Column, i: Column) -> Column:
        following = F.get(tokens, i + 1)
        quoted = t.rlike("^['\"]")
        name = F.when(t == "True", "true").when(t == "False", "false").when(t == "None", "null").otherwise(t)
        value = F.when(quoted, _json_string(t)).when(t == "(", "[").when(t == ")", "]").when((t == ",") & following.isin("]", ")", "}"), "").otherwise(name)
        return F.when(~quoted & (following == ":"), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(value)

    return F.array_join(F.transform(tokens, json), "")


def parse_literal(text: Column) -> Column:
    """map<string,string> of a dict literal (nested values as JSON text); the empty map for anything else."""
    parsed = F.from_json(literal_to_json(text), "map<string,string>")
    return F.coalesce(F.when(F.ltrim(text).startswith("{"), parsed), F.create_map().cast("map<string,string>"))


def write_literal(values: Column) -> Column:
    """A map<string,string> as a dict literal of quoted strings; null values are None."""
    def quoted(c: Column) -> Column:
        out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
        for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            out = F.replace(out, F.lit(raw), F.lit(shown))
        return F.concat(F.lit("'"), out, F.lit("'"))

    pairs = F.transform(F.map_entries(values), lambda e: F.concat(quoted(e["key"]), F.lit(": "), F.coalesce(quoted(e["value"]), F.lit("None"))))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
