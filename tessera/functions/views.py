r"""Lexical views of a source text as column expressions: code, comment, string literals, line layout.

Texts are cut into tokens by one pattern per language family (comment, string, anything else), and each
view keeps its tokens; what a view leaves out is replaced by its line ends, so line numbers agree. Patterns
use possessive loops, so long literals don't exhaust the regex engine's stack. An unterminated string ends
with its line, and an unterminated block comment is read as code.

Defined cases: a null text is the empty text; an unknown language has no comments and no strings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import count_of, text_of

_QUOTED = r'"(?:[^"\\\n]|\\.)*+"'
_APOSTROPHE = r"'(?:[^'\\\n]|\\.)*+'"
_SQL_STRING = r"'(?:[^']|'')*+'"


@dataclass(frozen=True)
class Family:
    """How a family of languages writes comments and strings; ``starts`` are their first characters."""

    comment: str
    string: str
    starts: str

    @property
    def token(self) -> str:
        return rf"(?s)(?:{self.comment})|(?:{self.string})|[^{self.starts}]++|."


#: The language families.
FAMILIES = {
    "c": Family(r"//[^\n]*+|/\*.*?\*/", rf"{_QUOTED}|{_APOSTROPHE}", "\"'/"),
    "python": Family(r"#[^\n]*+", rf"\"\"\".*?\"\"\"|'''.*?'''|{_QUOTED}|{_APOSTROPHE}", "\"'#"),
    "shell": Family(r"#[^\n]*+", rf"{_QUOTED}|'[^']*+'", "\"'#"),
    "php": Family(r"(?://|#)[^\n]*+|/\*.*?\*/", rf"{_QUOTED}|{_APOSTROPHE}", "\"'/#"),
    "sql": Family(r"--[^\n]*+|/\*.*?\*/", rf"{_SQL_STRING}|\"[^\"]*+\"", "\"'/-"),
    "markup": Family(r"<!--.*?-->", r"\"[^\"<>]*+\"|'[^'<>]*+'", "\"'<"),
    "basic": Family(r"'[^\n]*+", r"\"(?:[^\"\n]|\"\")*+\"", "\"'"),
    "lisp": Family(r";[^\n]*+", _QUOTED, "\";"),
    "dashes": Family(r"--[^\n]*+", rf"{_QUOTED}|{_APOSTROPHE}", "\"'-"),
    "percent": Family(r"%[^\n]*+", rf"{_QUOTED}|{_APOSTROPHE}", "\"'%"),
    "bang": Family(r"![^\n]*+", rf"{_QUOTED}|{_SQL_STRING}", "\"'!"),
    "pascal": Family(r"//[^\n]*+|\{.*?\}|\(\*.*?\*\)", _SQL_STRING, "'/{("),
    "abap": Family(r"\"[^\n]*+|(?<=\n)\*[^\n]*+", r"'(?:[^'\n]|'')*+'|`[^`\n]*+`", "\"'`*"),
    "cobol": Family(r"(?<=\n.{6})[*/][^\n]*+", rf"{_QUOTED}|'[^'\n]*+'", "\"'*/"),
    "none": Family(r"(?!)", r"(?!)", "\x00"),
}

#: Languages by family.
LANGUAGES = {
    "c": ["C", "CCpp", "Cpp", "Hpp", "ObjC", "ObjCCpp", "Java", "JS", "TypeScript", "CS", "Go", "Groovy", "Kotlin", "Scala", "Swift", "Rust", "Apex", "FS"],
    "python": ["Python"],
    "shell": ["Ksh", "Ruby", "Perl", "R", "CoffeeScript"],
    "php": ["PHP"],
    "sql": ["PlSql", "TSql", "MySQL", "MariaDB", "PostgreSQL", "DB2", "PL1"],
    "markup": ["JSP", "HTML", "XML", "Coldfusion"],
    "basic": ["VbDotNet"],
    "lisp": ["Lisp", "Clojure", "Assembly"],
    "dashes": ["Ada", "Lua"],
    "percent": ["Erlang", "Matlab"],
    "bang": ["Fortran"],
    "pascal": ["Delphi"],
    "abap": ["Abap"],
    "cobol": ["Cobol"],
}
FAMILY_OF = {language: family for family, own in LANGUAGES.items() for language in own}


def _line_ends(token: Column) -> Column:
    return F.regexp_replace(token, r"[^\n]+", "")


def tokens(text: Column, family: str) -> Column:
    return F.regexp_extract_all(text_of(text), F.lit(FAMILIES[family].token), F.lit(0))


def _starts(token: Column, pattern: str) -> Column:
    return F.rlike(token, F.lit(rf"(?s)^(?:{pattern})"))


def is_comment(token: Column, family: str) -> Column:
    # a look-behind can't see past a token that stands alone: such comments are told by their first character and length
    plain = FAMILIES[family].comment.replace(r"(?<=\n.{6})", "").replace(r"(?<=\n)", "")
    return _starts(token, plain) & ((F.length(token) > 1) | (family not in ("cobol", "abap")))


def is_string(token: Column, family: str) -> Column:
    return _starts(token, rf"(?:{FAMILIES[family].string})$")


def code_view(text: Column, family: str) -> Column:
    """The text with comments blanked and every string literal written as ``"CHAINE"``."""
    one = lambda t: F.when(is_comment(t, family), _line_ends(t)).when(is_string(t, family), F.concat(F.lit('"CHAINE"'), _line_ends(t))).otherwise(t)
    return F.array_join(F.transform(tokens(text, family), one), "")


def bare_view(text: Column, family: str) -> Column:
    """The text with comments blanked and string literals as they are."""
    return F.array_join(F.transform(tokens(text, family), lambda t: F.when(is_comment(t, family), _line_ends(t)).otherwise(t)), "")


def comment_view(text: Column, family: str) -> Column:
    """The comments, at their lines."""
    return F.array_join(F.transform(tokens(text, family), lambda t: F.when(is_comment(t, family), t).otherwise(_line_ends(t))), "")


def string_literals(text: Column, family: str) -> Column:
    """The string literals with their quotes, in order, repeats included."""
    return F.filter(tokens(text, family), lambda t: is_string(t, family))


def literal_counts(literals: Column) -> Column:
    """A map of each different literal to the number of its uses, from the runs of the sorted literals."""
    ordered = F.array_sort(literals)
    heads = F.filter(F.transform(ordered, lambda s, i: F.when((i == 0) | (s != F.get(ordered, i - 1)), i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(heads, F.lit(2), F.size(heads)), F.array(F.size(ordered)))
    return F.map_from_arrays(F.transform(heads, lambda i: F.get(ordered, i)), F.when(F.size(heads) > 0, F.zip_with(heads, ends, lambda a, b: b - a)).otherwise(F.array().cast("array<int>")))


def line_layout(code: Column, comment: Column) -> Column:
    """A line of P (has code) and C (has comment) letters for each line."""
    pairs = F.arrays_zip(F.split(code, "\n", -1).alias("p"), F.split(comment, "\n", -1).alias("c"))
    mark = lambda x: F.concat(F.when(F.rlike(x["p"], F.lit(r"\S")), F.lit("P")).otherwise(F.lit("")), F.when(F.rlike(x["c"], F.lit(r"\S")), F.lit("C")).otherwise(F.lit("")))
    return F.array_join(F.transform(pairs, mark), "\n")


def comment_blocks(layout: Column) -> Column:
    """Runs of comment-only lines, blank lines aside, and comments behind code, one each."""
    packed = F.concat(F.regexp_replace(F.regexp_replace(layout, r"\n+", "\n"), r"^\n|\n$", ""), F.lit("\n"))
    return count_of(packed, r"(?dm)^PC$") + count_of(packed, r"(?dm)(?:^C\n)+")


def lexical_views(text: Column, family: str) -> Column:
    """A struct of text, code, bare, comment and strings."""
    return F.struct(text_of(text).alias("text"), code_view(text, family).alias("code"), bare_view(text, family).alias("bare"), comment_view(text, family).alias("comment"), string_literals(text, family).alias("strings"))
