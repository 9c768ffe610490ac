"""Cheap predicates before parsing and compiling, and how compiler messages are judged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.java import ensure_outer_class, ensure_std_imports, has_class_word, sanitize_test
from corpusmill.functions.text import any_of, is_blank, let, lines, occurrences, strip

# Fixed values.
FATAL = ("illegal start of (?:type|expression)", "unclosed string literal", "reached end of file while parsing", "';' expected", "class, interface, or enum expected", "not a statement", "invalid method declaration")
SOFT = ("package .* does not exist", "cannot find symbol", "class file for .* not found")
JUNK = ("type", "null", "undefined")


def trivially_invalid(code: Column) -> Column:
    """Too short, a junk word, an odd number of quotes, or braces or parentheses that don't pair up."""
    s = strip(code)
    unpaired = lambda a, b: occurrences(code, a) != occurrences(code, b)
    return F.coalesce((F.length(s) < 10) | F.lower(s).isin(*JUNK) | (occurrences(code, '"') % 2 != 0) | unpaired("{", "}") | unpaired("(", ")"), F.lit(True))


def to_parse(code: Column) -> Column:
    """The code, inside a class of its own if it names none."""
    return F.when(has_class_word(code), code).otherwise(F.concat(F.lit("public class Dummy { "), code, F.lit(" }")))


def trivially_bad(src: Column) -> Column:
    """Blank, unpaired braces, or no test annotation."""
    return F.coalesce(is_blank(src) | (occurrences(src, "{") != occurrences(src, "}")) | ~src.contains("@Test"), F.lit(True))


def repaired(src: Column) -> Column:
    """The source as it goes to the compiler."""
    return let(let(ensure_outer_class(src), sanitize_test), ensure_std_imports)


def is_fatal(stderr: Column) -> Column:
    return F.exists(lines(stderr), lambda x: any_of([x.rlike(p) for p in FATAL]))


def only_soft(stderr: Column, messages_only: bool = False) -> Column:
    """There are lines and each says that something is missing. messages_only: looks only at lines that carry `error:`."""
    of_interest = F.filter(lines(stderr), lambda x: x.contains("error:")) if messages_only else lines(stderr)
    return let(of_interest, lambda ls: (F.size(ls) > 0) & F.forall(ls, lambda x: any_of([x.rlike(p) for p in SOFT])))


def compile_status(returned: Column, stderr: Column, messages_only: bool = False) -> Column:
    err = F.coalesce(stderr, F.lit(""))
    return F.when(returned == 0, "HARD_PASS").when(~is_fatal(err) & only_soft(err, messages_only), "SOFT_PASS").otherwise("HARD_FAIL")


def compile_message(returned: Column, stderr: Column) -> Column:
    """The first line of what the compiler said."""
    return F.when(returned == 0, "").otherwise(F.coalesce(F.get(lines(F.coalesce(stderr, F.lit(""))), F.lit(0)), F.lit("unknown error")))
