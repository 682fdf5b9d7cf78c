r"""Counts over the lines and characters of a text column, as plain column expressions.

A null text counts as the empty text. Lines end with ``\n``; where a rule says "terminated", a last line
without ``\n`` isn't counted. All patterns stay in the subset that Java's and RE2's engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_of(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_text(text: Column) -> Column:
    """The text with a control sign for each one beyond ASCII: words then end where they do for engines whose word edges are ASCII's."""
    return F.regexp_replace(text_of(text), r"[^\x00-\x7F]", "\x01")


def count_of(text: Column, pattern: str) -> Column:
    """Matches of ``pattern``, as bigint."""
    return F.regexp_count(text_of(text), F.lit(pattern)).cast("bigint")


def lines(text: Column) -> Column:
    return F.split(text_of(text), "\n", -1)


def line_count(text: Column) -> Column:
    """Line ends."""
    t = text_of(text)
    return (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("bigint")


def terminated(text: Column) -> Column:
    """The text up to its last line end: patterns that end with one then never look for it in vain."""
    t = text_of(text)
    return F.substring(t, F.lit(1), F.length(t) - F.length(F.substring_index(t, "\n", -1)))


def nonempty_lines(text: Column) -> Column:
    """Terminated lines with something other than white space."""
    return count_of(terminated(text), r"\S[^\n]*\n")


def blank_lines(text: Column) -> Column:
    """Terminated lines of white space only."""
    return count_of(text, r"(?dm)^[ \t\x0B\f\r]*\n")


def alnum_lines(text: Column) -> Column:
    """Terminated lines with an ASCII letter or digit."""
    return count_of(terminated(text), r"[A-Za-z0-9][^\n]*\n")


def long_lines(text: Column, over: int) -> Column:
    """Lines of more than ``over`` characters."""
    return count_of(text, rf"(?dm)^[^\n]{{{over + 1}}}")


def lines_like(text: Column, pattern: str) -> Column:
    """Lines in which ``pattern`` is found."""
    return F.size(F.filter(lines(text), lambda x: F.rlike(x, F.lit(pattern)))).cast("bigint")


#: What makes a comment line suspicious, in lower case.
SUSPICIOUS = r"[!?][!?]+|\b(?:à|a)\s+(?:v(?:é|e)rifier|faire|voir|revoir)|\b(?:todo|fixme|tbc|tbd|attention)\b"
SUSPICIOUS_INTERNATIONAL = SUSPICIOUS + r"|to\s+be\s+(?:verified|done)|\bwarning\b"


def suspicious_lines(comment: Column, international: bool = False) -> Column:
    """Lines with a mark of unfinished work, one for each line."""
    return lines_like(F.lower(text_of(comment)), SUSPICIOUS_INTERNATIONAL if international else SUSPICIOUS)


#: Words that start a statement when a bracket, nothing, or a colon further on follows.
STARTS = {"bracket": ["if", "while", "for", "foreach", "switch"], "alone": ["else"], "colon": ["case", "default"]}


def commented_out_lines(comment: Column) -> Column:
    """Comment lines whose last sign ends a statement, or whose first word starts one."""

    def like_code(line: Column) -> Column:
        bare = F.regexp_replace(line, r"^[\s/*]+|[\s/*]+$", "")
        word = F.regexp_extract(bare, r"^[a-z]+", 0)
        rest = F.regexp_replace(bare, r"^[a-z]+\s*", "")
        opens = word.isin(*STARTS["bracket"]) & F.startswith(rest, F.lit("("))
        return F.right(bare, F.lit(1)).isin(";", "{", "}") | opens | word.isin(*STARTS["alone"]) | (word.isin(*STARTS["colon"]) & F.contains(rest, F.lit(":")))

    return F.size(F.filter(lines(comment), like_code)).cast("bigint")


def magic_numbers(code: Column) -> Column:
    """Words that start with a digit, but for single digits, 0. and 1. forms, macro definitions and declarations of constants."""
    statements = F.filter(F.split(text_of(code), r"[\n;]"), lambda s: ~F.rlike(s, F.lit(r"^\s*#\s*define\b|^\s*(?:const|final)\b[^=]*=")))
    words = F.flatten(F.transform(statements, lambda s: F.regexp_extract_all(s, F.lit(r"[\w.]+"), F.lit(0))))
    return F.size(F.filter(words, lambda w: F.rlike(w, F.lit(r"^\.?\d")) & ~F.rlike(w, F.lit(r"^(?:0*\d|[01]?\.0?)\.*$")))).cast("bigint")


def ternary_operators(code: Column) -> Column:
    bare = F.regexp_replace(text_of(code), r"<\s*\?\s*>", "")
    return (F.length(bare) - F.length(F.replace(bare, F.lit("?"), F.lit("")))).cast("bigint")


def complex_conditions(code: Column, least: int = 4) -> Column:
    """Conditions of if, while, for and so on that use both && and || and at least ``least`` of them in all.

    One pass over brackets and signs that counts how deep it stands, so brackets may nest as they like; a
    condition without its closing bracket doesn't count.
    """
    signs = F.regexp_extract_all(text_of(code), F.lit(r"#\s*(?:if|elif)\b|\b(?:if|while|for|until|elsif|elseif)\s*\(|[()]|&&|\|\|"), F.lit(0))
    state = F.struct(*[F.lit(0).alias(k) for k in ("deep", "both", "either", "found")])

    def step(s: Column, x: Column) -> Column:
        up, down = F.endswith(x, F.lit("(")), x == ")"
        opens = up & (F.length(x) > 1) & (s["deep"] == 0)
        deep = F.when(opens, 1).when(s["deep"] == 0, 0).when(up, s["deep"] + 1).when(down, s["deep"] - 1).otherwise(s["deep"])
        inside = s["deep"] > 0
        both = F.when(opens, 0).otherwise(s["both"] + (inside & (x == "&&")).cast("int"))
        either = F.when(opens, 0).otherwise(s["either"] + (inside & (x == "||")).cast("int"))
        ends = inside & down & (s["deep"] == 1) & (s["both"] > 0) & (s["either"] > 0) & (s["both"] + s["either"] >= least)
        return F.struct(deep.alias("deep"), both.alias("both"), either.alias("either"), (s["found"] + ends.cast("int")).alias("found"))

    return F.aggregate(signs, state, step, lambda s: s["found"]).cast("bigint")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; zero for an empty text. Runs of equal characters are counted in one pass over them sorted."""
    chars = F.array_sort(F.filter(F.split(text_of(text), ""), lambda c: c != ""))
    n = F.length(text_of(text))
    state = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))
    part = lambda run: F.when(run > 0, run * F.log2(run.cast("double"))).otherwise(F.lit(0.0))

    def step(s: Column, c: Column) -> Column:
        same = c == s["last"]
        return F.struct(c.alias("last"), F.when(same, s["run"] + 1).otherwise(1).alias("run"), F.when(same, s["sum"]).otherwise(s["sum"] + part(s["run"])).alias("sum"))

    total = F.aggregate(chars, state, step, lambda s: s["sum"] + part(s["run"]))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(F.lit(0.0))


def split_at(text: Column, mark: str) -> tuple[Column, Column]:
    """What stands before the first ``mark``, and what stands behind it (null without one)."""
    t = text_of(text)
    at = F.locate(mark, t)
    return F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t), F.when(at > 0, F.substring(t, at + len(mark), F.length(t)))


def common_prefix(paths: Column) -> Column:
    """The longest directory that all of an array of paths lie in."""
    parts = F.transform(paths, lambda p: F.split(F.regexp_replace(p, r"/[^/]*$", ""), "/"))
    first = F.element_at(parts, 1)
    same = lambda n: F.forall(parts, lambda p: F.slice(p, F.lit(1), n) == F.slice(first, F.lit(1), n))
    best = F.array_max(F.filter(F.sequence(F.lit(0), F.size(first)), lambda n: (n == 0) | same(n)))
    return F.when(F.size(paths) > 0, F.array_join(F.slice(first, F.lit(1), best), "/"))


# Brackets and line ranges

#: Brackets and their partners.
PAIRS = {"(": ")", "[": "]", "{": "}"}


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], chunk: int = 512) -> Column:
    """The states behind each item of an array, from ``step`` (state, item).

    A fold that adds a state to an array copies the array each time, so states are gathered by chunk first: the
    work is that of the items times the chunk, not times the items.
    """
    first = F.array(zero)
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / chunk).cast("int") - 1), lambda i: F.slice(items, i * chunk + 1, F.lit(chunk)))

    def of_chunk(out: Column, own: Column) -> Column:
        last = F.element_at(F.element_at(out, -1), -1)
        states = F.aggregate(own, F.array(last), lambda o, x: F.concat(o, F.array(step(F.element_at(o, -1), x))))
        return F.concat(out, F.array(F.slice(states, F.lit(2), F.size(own))))

    every = F.aggregate(chunks, F.array(first), of_chunk, lambda o: F.flatten(F.slice(o, F.lit(2), F.size(o))))
    return F.when(F.size(items) > 0, every).otherwise(F.slice(first, F.lit(1), F.lit(0)))


def _depths(text: Column) -> Column:
    """(i: place from 1, c: sign, d: depth behind it) of each bracket and of what stands between them."""
    signs = F.regexp_extract_all(text_of(text), F.lit(r"[^()\[\]{}]+|[()\[\]{}]"), F.lit(0))
    turn = lambda c: F.when(c.isin(*PAIRS), 1).when(c.isin(*PAIRS.values()), -1).otherwise(0)
    zero = F.struct(F.lit(1).alias("next"), F.lit(1).alias("i"), F.lit("").alias("c"), F.lit(0).alias("d"))
    step = lambda s, c: F.struct((s["next"] + F.length(c)).alias("next"), s["next"].alias("i"), c.alias("c"), (s["d"] + turn(c)).alias("d"))
    return scan(signs, zero, step)


def bracketed(text: Column) -> Column:
    """(inside, behind) of the first bracket of a text and its partner; nulls where there is none, or where it isn't closed."""
    t = text_of(text)
    at = F.regexp_instr(t, F.lit(r"[(\[{]"))
    own = F.substring(t, at, F.length(t))
    end = F.try_element_at(F.filter(_depths(own), lambda x: (x["d"] == 0) & x["c"].isin(*PAIRS.values())), F.lit(1))["i"]
    found = (at > 0) & end.isNotNull()
    return F.struct(F.when(found, F.substring(own, F.lit(2), end - 2)).alias("inside"), F.when(found, F.substring(own, end + 1, F.length(own))).alias("behind"))


def split_outside(text: Column, mark: str) -> Column:
    """The parts of a text between the places of a one-sign ``mark`` that stand outside all brackets."""
    pieces = F.transform(_depths(text), lambda x: F.when(x["d"] == 0, F.replace(x["c"], F.lit(mark), F.lit("\x00"))).otherwise(x["c"]))
    return F.split(F.array_join(pieces, ""), "\x00", -1)


def line_range(text: Column, first: Column | int, last: Column | int) -> Column:
    """The lines from ``first`` to ``last`` (from 1), with their line ends between them; empty where there are none."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (first, last))
    return F.array_join(F.slice(lines(text), F.greatest(F.lit(1), a), F.greatest(F.lit(0), b - F.greatest(F.lit(1), a) + 1)), "\n")


def missing_braces(code: Column) -> Column:
    """Control words (if, while, for, else, do) whose statement isn't in braces, empty ones aside; the brackets behind them are skipped as a whole."""
    signs = F.regexp_extract_all(text_of(code), F.lit(r"\b(?:else\s+if|if|while|for|else|do)\b|[(){};]|[^\s(){};]+"), F.lit(0))
    state = F.struct(F.lit("").alias("wait"), F.lit(0).alias("deep"), F.lit("").alias("last"), F.lit(0).alias("found"))
    bracket = ("if", "while", "for")

    def step(s: Column, x: Column) -> Column:
        word = F.when(F.startswith(x, F.lit("else ")) | F.rlike(x, F.lit(r"^else\s+if$")), F.lit("if")).otherwise(x)
        control = word.isin("if", "while", "for", "else", "do")
        deep = s["deep"] + F.when(x == "(", 1).when((x == ")") & (s["deep"] > 0), -1).otherwise(0)
        # behind a control word: its brackets first, then a brace, or it is found
        tail = (s["last"] == "}") & (x == "while")  # the end of do {} while ()
        judged = (s["wait"] == "open") & (s["deep"] == 0)
        fails = judged & (x != "{") & ~((x == "(") & s["last"].isin(*bracket)) & (x != ";")
        wait = F.when(tail, F.lit("")).when(control, F.lit("open")).when(judged & (x == "("), F.lit("open")).when(judged, F.lit("")).otherwise(s["wait"])
        return F.struct(wait.alias("wait"), deep.alias("deep"), word.alias("last"), (s["found"] + fails.cast("int")).alias("found"))

    return F.aggregate(signs, state, step, lambda s: s["found"]).cast("bigint")
