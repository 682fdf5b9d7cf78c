r"""Lexical views of languages whose literals and comments nest, or whose signs mean something else by what stands before.

One pattern a family (``views``) can't tell a regular expression from a division, code inside a template, a comment
inside a comment, or a text block. Here a language has states, each a list of (pattern, move): a move keeps the state, enters another
one on a stack, or goes back. What is matched outside the first state belongs to the comment or literal that was entered
from it, however deep the stack is; so a template with code in it, and templates in that, is one literal. A text
is read once, from left to right.

Defined cases: a null text is the empty text; a literal or comment that isn't closed goes on to the end of the text, but for
plain quotes, which end with their line (a quote without a partner on it is code).
"""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import text_of

CODE, COMMENT, STRING, PATTERN = "PCSR"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'"
#: What may stand before a regular expression: a sign that ends no operand (but for <, which begins tags), or a word that is none.
_BEFORE_PATTERN = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%~^>]|\b(?:return|typeof|case|in|of|delete|void|throw|new|instanceof|do|else|yield|await|and|or|not|if|unless|while|when))$")
_SLASHED = r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_HEREDOC = r"(?:.*?^[ \t]*(?P={0})\b|.*\Z)"

#: A rule is (pattern, kind or state or None or "back"): a kind makes one token of the match, a state is entered, None goes on.
_C_COMMENTS = [(r"//[^\n]*", COMMENT), (r"/\*.*?(?:\*/|\Z)", COMMENT)]
_NESTED = [(r"//[^\n]*", COMMENT), (r"/\*", "nested")]
_NESTED_STATE = [(r"/\*", "nested"), (r"\*/", "back"), (r"[^*/]+", None)]
_QUOTES = [(_DOUBLE, STRING), (_SINGLE, STRING)]


def _until(close: str, *inside: tuple[str, str | None]) -> list[tuple[str, str | None]]:
    """A state that ends with ``close``; a sign behind a backslash doesn't."""
    return [(r"\\.", None), (close, "back"), *inside]


def _braced(*code: tuple[str, str | None]) -> list[tuple[str, str | None]]:
    """Code in a literal: it ends with the brace that closes the one before it."""
    return [*code, (r"\{", "braced"), (r"\}", "back")]


_JS = [*_C_COMMENTS, *_QUOTES, ("`", "template"), (_SLASHED, PATTERN)]
_KOTLIN = [*_NESTED, (r'"""', "block"), (r'"', "quoted"), (_SINGLE, STRING)]
_SCALA = [*_NESTED, (r'\b(?:s|f|raw)"""', "block"), (r'"""', "plain"), (r'\b(?:s|f|raw)"', "quoted"), (_DOUBLE, STRING), (r"'(?:[^'\\\n]|\\.[^'\n]*)'", STRING)]
_SWIFT = [*_NESTED, (r'(?P<h>#+)".*?(?:"(?P=h)|\Z)', STRING), (r'"""', "block"), (r'"', "quoted")]
_CS = [*_C_COMMENTS, (r'(?P<q>"{3,}).*?(?:(?P=q)|\Z)', STRING), (r'@"(?:[^"]|"")*"', STRING), (r'(?:\$@|@\$)"', "verbatim"), (r'\$"', "quoted"), *_QUOTES]
_GROOVY = [*_C_COMMENTS, (r"'''", "single block"), (r'"""', "block"), (r'"', "quoted"), (_SINGLE, STRING), (_SLASHED, PATTERN)]
_RUBY = [(r"^=begin\b.*?(?:^=end\b[^\n]*|\Z)", COMMENT), (r"^__END__\n.*", COMMENT), (r"#[^\n]*", COMMENT), (rf"<<[~-]?(?P<q>[\"'`]?)(?P<t>[A-Z_]\w*)(?P=q)[^\n]*\n{_HEREDOC.format('t')}", STRING), (r'"', "quoted"), (_SINGLE, STRING), (_SLASHED, PATTERN)]
_LINE_END = (r"(?=\n)", "back")

#: The states of each language; the first is that of code.
LEXERS: dict[str, dict[str, list]] = {
    "JS": {"code": _JS, "template": _until("`", (r"\$\{", "braced")), "braced": _braced(*_JS)},
    "Java": {"code": [*_C_COMMENTS, (r'"""', "block"), *_QUOTES], "block": _until('"""')},
    "Kotlin": {"code": _KOTLIN, "nested": _NESTED_STATE, "block": [(r'"""+', "back"), (r"\$\{", "braced")], "quoted": _until('"', (r"\$\{", "braced"), _LINE_END), "braced": _braced(*_KOTLIN)},
    "Scala": {"code": _SCALA, "nested": _NESTED_STATE, "plain": [(r'"""+', "back")], "block": [(r'"""+', "back"), (r"\$\{", "braced")], "quoted": _until('"', (r"\$\{", "braced"), _LINE_END), "braced": _braced(*_SCALA)},
    "Swift": {"code": _SWIFT, "nested": _NESTED_STATE, "block": [(r"\\\(", "bracket"), *_until('"""')], "quoted": [(r"\\\(", "bracket"), *_until('"', _LINE_END)], "bracket": [*_SWIFT, (r"\(", "bracket"), (r"\)", "back")]},
    "Rust": {"code": [*_NESTED, (r'\bb?r(?P<h>#*)".*?(?:"(?P=h)|\Z)', STRING), (r'b?"(?:[^"\\]|\\.)*"', STRING), (r"b?'(?:[^'\\\n]|\\.[^'\n]*)'", STRING)], "nested": _NESTED_STATE},
    "CS": {"code": _CS, "verbatim": [('""', None), ('"', "back"), (r"\{\{", None), (r"\{", "braced")], "quoted": _until('"', (r"\{\{", None), (r"\{", "braced"), _LINE_END), "braced": _braced(*_CS)},
    "Go": {"code": [*_C_COMMENTS, (r"`[^`]*`", STRING), *_QUOTES]},
    "Groovy": {"code": _GROOVY, "single block": _until("'''"), "block": _until('"""', (r"\$\{", "braced")), "quoted": _until('"', (r"\$\{", "braced"), _LINE_END), "braced": _braced(*_GROOVY)},
    "Ruby": {"code": _RUBY, "quoted": _until('"', (r"#\{", "braced")), "braced": _braced(*_RUBY)},
    "Perl": {"code": [(r"^=[a-z]\w*\b.*?(?:^=cut\b[^\n]*|\Z)", COMMENT), (r"(?<!\$)#[^\n]*", COMMENT), *_QUOTES]},
    "PHP": {"code": [(r"//[^\n]*|#(?!\[)[^\n]*", COMMENT), (r"/\*.*?(?:\*/|\Z)", COMMENT), (rf"<<<[ \t]*(?P<q>[\"']?)(?P<t>\w+)(?P=q)\n{_HEREDOC.format('t')}", STRING), *_QUOTES]},
    "Lua": {"code": [(r"--\[(?P<e>=*)\[.*?(?:\](?P=e)\]|\Z)", COMMENT), (r"--[^\n]*", COMMENT), (r"\[(?P<f>=*)\[.*?(?:\](?P=f)\]|\Z)", STRING), *_QUOTES]},
    "PostgreSQL": {"code": [(r"--[^\n]*", COMMENT), (r"/\*", "nested"), (r"(?P<d>\$(?:[A-Za-z_]\w*)?\$).*?(?:(?P=d)|\Z)", STRING), (r"'(?:[^']|'')*'", STRING), (r'"[^"]*"', STRING)], "nested": _NESTED_STATE},
    "TSql": {"code": [(r"--[^\n]*", COMMENT), (r"/\*", "nested"), (r"'(?:[^']|'')*'", STRING), (r'"[^"]*"', STRING)], "nested": _NESTED_STATE},
}
LEXERS["TypeScript"] = LEXERS["JS"]
#: Runs of signs at which no rule begins, read in one step: in code whole words too, but for those that a quote or # follows. Each state's rules are tried wherever a run ends.
_CODE_RUN = r"(?:(?!__END__)[^\W\d]\w*+(?![\"'`#])|[\s\d;,.:!?+*%&|>~])+"
_TEXT_RUN = r"[\w \t,.;:]+"
#: The last word or sign of a run.
_LAST = re.compile(r"([^\W\d]\w*|\S)\s*\Z")
#: What a state entered from code makes of all that follows.
_MADE = {"nested": COMMENT}


@cache
def _compiled(language: str) -> dict[str, tuple[re.Pattern, list]]:
    out = {}
    for state, rules in LEXERS[language].items():
        parts = [re.sub(r"\(\?P([<=])(\w)", rf"(?P\g<1>\g<2>{i}_", p) for i, (p, _) in enumerate(rules)]
        plain = rf"{_CODE_RUN}|[^\W\d]\w*|\s+|." if state in ("code", "braced", "bracket") else f"{_TEXT_RUN}|."
        out[state] = (re.compile("|".join([*(f"(?P<r{i}>{p})" for i, p in enumerate(parts)), plain]), re.S | re.M), [move for _, move in rules])
    return out


def tokens(text: str, language: str) -> list[tuple[str, str]]:
    """(kind, text) of what a text consists of, in order; adjacent code is one token."""
    states, kinds = _compiled(language), (COMMENT, STRING, PATTERN)
    out: list[tuple[str, str]] = []
    stack = ["code"]
    at = begun = code = 0
    before = ""
    while at < len(text):
        pattern, moves = states[stack[-1]]
        m = pattern.match(text, at)
        move = moves[int(m.lastgroup[1:])] if m.lastgroup else None
        end = m.end()
        if move == PATTERN:
            last = _LAST.search(before)
            if not _BEFORE_PATTERN.search(last[1] if last else before):
                move, end = None, at + 1
        if len(stack) == 1:
            if move in kinds or move in states:
                if code < at:
                    out.append((CODE, text[code:at]))
                begun = at
            if move in kinds:
                out.append((move, text[at:end]))
                code, before = end, '"'
            elif move in states:
                stack.append(move)
            elif not text[at:end].isspace():
                before = text[at:end]
        elif move == "back":
            stack.pop()
            if len(stack) == 1:
                out.append((_MADE.get(entered, STRING), text[begun:end]))
                code, before = end, '"'
            else:
                before = '"'
        elif move in states:
            stack.append(move)
            before = "{"
        elif stack[-1] in ("braced", "bracket") and not text[at:end].isspace():
            before = '"' if move in kinds else text[at:end]
        if len(stack) == 2 and begun == at:
            entered = stack[1]
        at = end
    if len(stack) > 1:
        out.append((_MADE.get(entered, STRING), text[begun:]))
    elif code < len(text):
        out.append((CODE, text[code:]))
    return out


def token_column(text: Column, language: str) -> Column:
    """An array of kind (P code, C comment, S string, R regular expression) and text."""

    @F.pandas_udf("array<struct<kind: string, text: string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "text": t} for k, t in tokens(one, language)] for one in texts], dtype=object)

    return cut(text_of(text))


def _ends(text: str) -> str:
    return "\n" * text.count("\n")


def lexical_views(text: Column, language: str) -> Column:
    """A struct of text, code, bare, comment and strings, as ``views.lexical_views`` gives it; regular expressions are literals in code, and no strings."""

    @F.pandas_udf("code string, bare string, comment string, strings array<string>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for one in texts:
            found = tokens(one, language)
            code = "".join(t if k == CODE else _ends(t) if k == COMMENT else '"CHAINE"' + _ends(t) for k, t in found)
            bare = "".join(_ends(t) if k == COMMENT else t for k, t in found)
            comment = "".join(t if k == COMMENT else _ends(t) for k, t in found)
            rows.append((code, bare, comment, [t for k, t in found if k == STRING]))
        return pd.DataFrame(rows, columns=["code", "bare", "comment", "strings"])

    own = cut(text_of(text))
    return F.struct(text_of(text).alias("text"), own["code"].alias("code"), own["bare"].alias("bare"), own["comment"].alias("comment"), own["strings"].alias("strings"))
