"""Python text rules as Column expressions: strip, capitalize, repr, literals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from procspark.functions.arrays import let

# What Python's str.strip() treats as white space, as a Java
# character class (needs the (?U) flag for the Unicode part).
PY_SPACE = r"[\s\x1c-\x1f]"

# Fixed value: characters that repr() writes as an escape.
NOT_PRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"

# Fixed value: characters that repr() does not write as they are, quotes aside.
ESCAPED = r"[\\\p{C}\p{Z}&&[^ ]]"

# Fixed value: a quoted Python string literal.
STRING_LITERAL = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\""""


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{PY_SPACE}+|{PY_SPACE}+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{PY_SPACE}+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U){PY_SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return F.length(strip(c)) == 0


def capitalize(c: Column) -> Column:
    """First character in title case, everything after it lower case."""
    head = F.upper(F.substring(c, 1, 1))
    return F.concat(F.substring(head, 1, 1),
                    F.lower(F.substr(head, F.lit(2))),
                    F.lower(F.substr(c, F.lit(2))))


def _escape_char(ch: Column) -> Column:
    code = F.ascii(ch)
    hexa = F.lower(F.hex(code))
    return (F.when(~ch.rlike(NOT_PRINTABLE), ch)
            .when(code < 0x100, F.concat(F.lit("\\x"), F.lpad(hexa, 2, "0")))
            .when(code < 0x10000, F.concat(F.lit("\\u"), F.lpad(hexa, 4, "0")))
            .otherwise(F.concat(F.lit("\\U"), F.lpad(hexa, 8, "0"))))


def py_repr(c: Column) -> Column:
    """``repr(str)``: single quotes unless the text holds only single quotes."""
    spelled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, esc in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        spelled = F.replace(spelled, F.lit(raw), F.lit(esc))
    body = F.when(c.rlike(ESCAPED), F.array_join(F.transform(F.split(spelled, ""), _escape_char), "")).otherwise(c)
    single, double = F.contains(c, F.lit("'")), F.contains(c, F.lit('"'))
    return (F.when(~single, F.concat(F.lit("'"), body, F.lit("'")))
            .when(~double, F.concat(F.lit('"'), body, F.lit('"')))
            .otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))))


def py_list_repr(c: Column) -> Column:
    """``str(list_of_str)``."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, py_repr), ", "), F.lit("]"))


def _decode_escape(piece: Column) -> Column:
    kind = F.substring(piece, 2, 1)
    rest = F.substr(piece, F.lit(3))
    coded = F.length(piece) > 2
    return (F.when(~F.startswith(piece, F.lit("\\")), piece)
            .when(coded & (kind == "x"), F.decode(F.unhex(F.concat(F.lit("00"), rest)), "UTF-16BE"))
            .when(coded & (kind == "u"), F.decode(F.unhex(rest), "UTF-16BE"))
            .when(coded & (kind == "U"), F.decode(F.unhex(rest), "UTF-32"))
            .when(kind == "n", F.lit("\n")).when(kind == "t", F.lit("\t"))
            .when(kind == "r", F.lit("\r")).otherwise(kind))


def _unquote(lit: Column) -> Column:
    body = F.substr(lit, F.lit(2), F.length(lit) - 2)
    pieces = F.regexp_extract_all(
        body, F.lit(r"(?s)\\(?:x[0-9a-f]{2}|u[0-9a-f]{4}|U[0-9a-f]{8}|.)|[^\\]+"), F.lit(0))
    return F.when(F.contains(body, F.lit("\\")),
                  F.array_join(F.transform(pieces, _decode_escape), "")).otherwise(body)


def string_literals(c: Column) -> Column:
    """All quoted literals of a Python expression, unquoted, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"(?s){STRING_LITERAL}"), F.lit(0)), _unquote)


def _skeleton(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"(?s){STRING_LITERAL}", "s"), r"\s", "")


def _reject(strict: bool, what: str, c: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"not a {what}: "), c)) if strict else F.lit(None)


def parse_set(c: Column, strict: bool = False) -> Column:
    """Text of a set of strings -> sorted distinct array; other text is null (or an error)."""
    ok = _skeleton(c).rlike(r"^(\{s[s,]*\}|set\(\))$")
    return F.when(ok, F.sort_array(F.array_distinct(string_literals(c)))).otherwise(
        _reject(strict, "set", c))


def parse_pairs(c: Column, strict: bool = False) -> Column:
    """Text of a list of string pairs -> array<struct<src, dst>> in text order."""
    pairs = let(string_literals(c), lambda flat: F.when(F.size(flat) > 1, F.transform(
        F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1),
        lambda i: F.struct(F.get(flat, i * 2).alias("src"), F.get(flat, i * 2 + 1).alias("dst")))
    ).otherwise(F.expr("cast(array() as array<struct<src:string,dst:string>>)")))
    ok = F.regexp_replace(_skeleton(c), r"[(\[]s,s,?[)\]]", "p").rlike(r"^\[[p,]*\]$")
    return F.when(ok, pairs).otherwise(_reject(strict, "list of pairs", c))
