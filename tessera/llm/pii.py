"""Personal data by candidate generation and gradient boosting, in DataFrame functions only.

Strict patterns give the base spans (email, ip, card, phone). Wide generators propose further spans, which
may overlap those and each other: card numbers with any check digit, phone numbers without a plus sign,
IPv6 addresses, mail addresses with spaces or words for their signs, account numbers, and opaque strings
that may be keys. Each candidate gets binned features of its format and context, and, where one can be had,
a label from a check that no feature shows: Luhn and mod-97 digits, a plus sign, the count of an address's
groups, plain ``@`` and dots, and words such as ``token`` before a string. What no check settles teaches nothing.
A number that fails its check digits is never added; as one in ten (or 97) passes by chance, a failing one
counts as a ninth (or 96th) of a counter-example, so the trees tell formats of real numbers from chance.
A seeded set of made examples and counter-examples adds formats that a corpus may lack.

Boosted trees are fitted on the histogram of (label, features) over all documents, which is bounded by the
product of the bins. Probabilities are calibrated on the half of the documents that the trees don't see,
and each kind's threshold is the lowest from 0.5 on at which that half has a precision of ``least_precision``. Trees and
calibration become one column expression. Candidates above their threshold that overlap no base span are
added; of overlapping ones the likelier, then the earlier stays. Base spans always stay.

The text is scanned once; what it gives (spans and candidates) is written to the shared folder, and all else
works on that. Places come from running sums in blocks and overlaps from windows over one document's spans, so
the work grows with a text's length and its matches. Character loops that could recurse in the regex engine
are avoided by first marking, in place, the separators that can't be inside a match.

Defined cases: null and empty texts have no spans; rows repeated get equal spans; ids may be null;
columns other than id and text are not looked at; a table without candidates adds nothing; an empty table
gives an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import random
import zlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged, text_of

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method finds.
MORE = ("account", "secret")
#: Stands for a separator that can't be inside a match.
MARK = "\x01"
_L = r"A-Za-z0-9._%+\x01-"
EMAIL = rf"(?:\G|(?<![{_L}]))[{_L}]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}"
CARD = r"[0-9][0-9\x20-]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The wide generators, by the kind of their spans.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?(?:@|\[at\]|\(at\))\x20?|\x20at\x20)[A-Za-z0-9-]+(?:(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?|\x20dot\x20)[A-Za-z0-9-]+){1,4}",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20.-][0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])[+(]?[0-9]{1,4}[)]?(?:[\x20()./-]{1,2}[0-9]{2,4}){2,5}(?![0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{16,}(?![A-Za-z0-9_/+=-])",
}
#: Words before a span, by what they announce; and those that announce a secret, which no feature shows.
CUES = {1: r"(?i)\b(?:tel|phone|call|fax|mobile|cell)\b[^0-9]*$", 2: r"(?i)\b(?:card|visa|iban|account)\b[^0-9]*$", 3: r"(?i)\b(?:ip|host|server|address)\b[^0-9]*$", 4: r"(?i)\b(?:e-?mail|mail|contact|write)\b[^0-9]*$"}
SECRET = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer)[\"']?\s*[=:]?\s*[\"']?$"

_BINS = {"size": (8, 12, 14, 17, 20, 28, 36, 44), "digits": (7, 8, 10, 11, 12, 14, 16, 20)}
#: Feature names and their numbers of bins.
FEATURES = {"kind": 6, "size": 9, "digits": 9, "groups": 6, "paren": 2, "dots": 5, "sep": 2, "upper": 2, "lower": 2, "hex": 2, "tail": 4, "quoted": 2, "assigned": 2, "cue": 5, "before": 3, "after": 3}
#: What a candidate that fails its check counts as.
CHANCE = {"card": 1 / 9, "account": 1 / 96}
#: Elements of an array whose running sums are folded together.
CHUNK = 256
_SPAN = "array<struct<a:int,b:int>>"
_ADDED = "array<struct<kind:string,a:int,b:int,p:double>>"


def settled(rows: DataFrame) -> DataFrame:
    """The same rows, with columns that the optimizer can't merge into expressions that use them more than once."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def _pieces(text: Column, pattern: str, gate: Column) -> Column:
    """(p: what stands before a match, m: the match), leftmost non-overlapping; the last has no match."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(gate, zipped).otherwise(F.array().cast("array<struct<p:string,m:string>>"))


def _chunks(array: str, one) -> Column:
    """``one`` (number of a chunk, its elements) for each ``CHUNK`` elements of an array column."""
    n = F.ceil(F.size(array) / CHUNK).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: one(k, F.slice(array, k * CHUNK + 1, F.lit(CHUNK))))).otherwise(F.array())


def found_spans(rows: DataFrame, wanted: dict[str, tuple[Column, str, Column]], made: dict) -> DataFrame:
    """``rows`` with an array column for each of ``wanted`` (text, pattern, gate): what ``made`` gives for (array of pieces, piece, number, a, b)."""
    own = list(wanted)
    rows = settled(rows.select("*", *[_pieces(*wanted[k]).alias(f"p_{k}") for k in own]).drop("text", "mail_text", "card_text"))
    steps = [F.transform(f"p_{k}", lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias(f"s_{k}") for k in own]
    rows = settled(rows.select("*", *steps))
    total = lambda s: F.aggregate(s, F.lit(0), lambda a, x: a + x)
    rows = settled(rows.select("*", *[_chunks(f"s_{k}", lambda _, s: total(s)).cast("array<int>").alias(f"u_{k}") for k in own]))

    def places(k: str) -> Column:
        def chunk(n: Column, s: Column) -> Column:
            state = F.struct(total(F.slice(f"u_{k}", F.lit(1), n)).alias("at"), F.array().cast("array<int>").alias("out"))
            return F.aggregate(s, state, lambda t, x: F.struct((t["at"] + x).alias("at"), F.concat(t["out"], F.array(t["at"])).alias("out")), lambda t: t["out"])

        return F.flatten(_chunks(f"s_{k}", chunk).cast("array<array<int>>"))

    rows = settled(rows.select("*", *[places(k).alias(f"a_{k}") for k in own]))

    def spans(k: str) -> Column:
        def one(x: Column, i: Column) -> Column:
            a = F.get(F.col(f"a_{k}"), i) + F.length(x["p"])
            return F.when(x["m"].isNotNull(), made[k](F.col(f"p_{k}"), x, i, a, a + F.length(x["m"])))

        return F.filter(F.transform(f"p_{k}", one), lambda s: s.isNotNull())

    return settled(rows.select("*", *[spans(k).alias(k) for k in own]).drop(*[f"{x}_{k}" for x in "psua" for k in own]))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(s: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return s + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _mod97(m: Column) -> Column:
    """Whether an account number's check digits are right."""
    own = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.filter(F.split(F.concat(F.substring(own, 5, 64), F.substring(own, 1, 4)), ""), lambda c: c != "")
    return F.aggregate(turned, F.lit(0), lambda s, c: F.when(c <= "9", s * 10 + c.cast("int")).otherwise(s * 100 + F.ascii(c) - 55) % 97) == 1


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: What a match of a strict pattern has to fulfil.
_CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.rlike(m, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
    "card": lambda m: F.when(F.length(_digits(m)).between(16, 19), _luhn(_digits(m))).otherwise(F.lit(False)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def _label(kind: str, m: Column, ahead: Column) -> Column:
    """1 or 0 where a check settles it, else null."""
    n = F.length(_digits(m))
    if kind == "email":
        return F.when(F.rlike(m, F.lit(r"^[^\s\[\](]+@[^\s\[\](]+$")), 1)
    if kind == "ip":
        groups = F.size(F.filter(F.split(m, ":"), lambda g: g != ""))
        return F.when((groups == 8) | (F.contains(m, F.lit("::")) & (groups > 2)), 1).otherwise(0)
    if kind == "card":
        return _luhn(_digits(m)).cast("int")
    if kind == "phone":
        date = F.rlike(m, F.lit(r"^(?:(?:19|20)[0-9]{2}[./-][0-9]{2}[./-][0-9]{2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2})\b"))
        return F.when(F.startswith(m, F.lit("+")), n.between(8, 15).cast("int")).when(date | (n < 7) | (n > 15), 0)
    if kind == "account":
        return _mod97(m).cast("int")
    return F.rlike(ahead, F.lit(SECRET)).cast("int")


def _class(c: Column) -> Column:
    return F.when(c.isNull() | (c == "") | F.rlike(c, F.lit(r"^\s$")), 0).when(F.rlike(c, F.lit(r"^[A-Za-z0-9]$")), 1).otherwise(2)


def _bin(x: Column, edges: tuple[int, ...]) -> Column:
    return reduce(lambda n, e: n + F.when(x >= e, 1).otherwise(0), edges, F.lit(0))


def _features(kind: str, m: Column, ahead: Column, after: Column) -> Column:
    held = lambda pattern: F.rlike(m, F.lit(pattern)).cast("int")
    cue = F.lit(0)
    for k, p in CUES.items():
        cue = F.when(F.rlike(ahead, F.lit(p)), k).otherwise(cue)
    before = F.right(ahead, F.lit(1))
    tail = F.when(F.rlike(m, F.lit(r"(?<![0-9])[0-9]{3}[^0-9]{1,2}[0-9]{4}$")), 1).when(F.rlike(m, F.lit(r"(?<![0-9])[0-9]{4}[^0-9]{1,2}[0-9]{4}$")), 2).when(F.rlike(m, F.lit(r"(?<![0-9])[0-9]{2}[^0-9]{1,2}[0-9]{2}$")), 3).otherwise(0)
    return F.struct(
        F.lit(list(GENERATORS).index(kind)).alias("kind"),
        _bin(F.length(m), _BINS["size"]).alias("size"),
        _bin(F.length(_digits(m)), _BINS["digits"]).alias("digits"),
        F.least(F.lit(5), F.regexp_count(m, F.lit("[0-9]+"))).alias("groups"),
        held(r"[\[(]").alias("paren"),
        F.least(F.lit(4), F.regexp_count(m, F.lit(r"\."))).alias("dots"),
        held(r"[\x20-]").alias("sep"),
        held("[A-Z]").alias("upper"),
        held("[a-z]").alias("lower"),
        held("^[0-9A-Fa-f]+$").alias("hex"),
        tail.alias("tail"),
        F.rlike(before, F.lit("[\"']")).cast("int").alias("quoted"),
        F.rlike(ahead, F.lit(r"[=:]\s*[\"']?$")).cast("int").alias("assigned"),
        cue.alias("cue"),
        _class(before).alias("before"),
        _class(after).alias("after"),
    )


def _base(check):
    return lambda pieces, x, i, a, b: F.when(check(x["m"]), F.struct(a.alias("a"), b.alias("b")))


def _candidate(kind: str):
    def one(pieces: Column, x: Column, i: Column, a: Column, b: Column) -> Column:
        m, ahead = x["m"], F.right(x["p"], F.lit(32))
        after = F.substring(F.get(pieces, i + 1)["p"], 1, 1)
        own = F.struct(a.alias("a"), b.alias("b"), _label(kind, m, ahead).alias("label"), _features(kind, m, ahead, after).alias("f"))
        return F.when(F.rlike(m, F.lit("[0-9]")) & F.rlike(m, F.lit("[A-Za-z]")), own) if kind == "secret" else own

    return one


def spans_and_candidates(rows: DataFrame) -> DataFrame:
    """``rows`` with an array of base spans for each kind and an array of candidates (a, b, label, f) for their ``text``."""
    text, keys = F.col("text"), [c for c in rows.columns if c != "text"]
    plain = F.when(F.contains(text, F.lit(MARK)), F.replace(text, F.lit(MARK), F.lit("\x02"))).otherwise(text)
    rows = rows.withColumn("at", F.contains(text, F.lit("@"))).withColumn("num", F.rlike(text, F.lit("[0-9]")))
    rows = rows.withColumn("mail_text", F.when(F.col("at"), F.regexp_replace(plain, r"\.(?![A-Za-z0-9-])|(?<![A-Za-z0-9-])\.", MARK)).otherwise(F.lit("")))
    rows = rows.withColumn("card_text", F.when(F.rlike(text, F.lit(r"(?:[0-9][\x20-]?){15}")), F.regexp_replace(text, r"[\x20-](?![0-9])|(?<![0-9])[\x20-]", MARK)).otherwise(F.lit("")))
    num, holds = F.col("num"), lambda s: F.contains(text, F.lit(s))
    wanted = {
        "email": (F.col("mail_text"), EMAIL, F.col("at")),
        "ip": (text, IP, num & holds(".")),
        "card": (F.col("card_text"), CARD, F.col("card_text") != ""),
        "phone": (text, PHONE, num & holds("+")),
    }
    spelled = holds("at]") | holds("at)") | (holds(" at ") & holds(" dot "))
    gates = {"email": F.col("at") | spelled, "ip": holds(":"), "account": num & F.rlike(text, F.lit("[A-Z]{2}[0-9]{2}"))}
    own = {f"c_{k}": (text, p, gates.get(k, num)) for k, p in GENERATORS.items()}
    made = {k: _base(check) for k, check in _CHECKS.items()} | {f"c_{k}": _candidate(k) for k in GENERATORS}
    found = found_spans(rows, wanted | own, made)
    return found.select(*keys, *[F.col(k).cast(_SPAN).alias(k) for k in KINDS], F.concat(*[f"c_{k}" for k in GENERATORS]).alias("candidates"))


def made_examples(seed: int = 5) -> list[tuple[str, str | None]]:
    """(text, kind): texts with one span of a kind, or with what is none of any kind (null), from fixed forms and seeded signs."""
    rng = random.Random(seed)
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    d = lambda n: some("123456789", n)
    name = lambda: rng.choice(["joe", "ann.lee", "m_berg", "kim7", "r.oz"])
    host = lambda: rng.choice(["example", "mail", "corp-net", "uni", "post"])
    top = lambda: rng.choice(["com", "org", "de", "net", "fr"])

    def card(length: int) -> str:
        own = d(length - 1)
        doubled = [int(c) * 2 - 9 * (int(c) > 4) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(own))]
        return own + str(-sum(doubled) % 10)

    def account(country: str, rest: str) -> str:
        return f"{country}{98 - int(''.join(str(int(c, 36)) for c in rest + country) + '00') % 97:02d}{rest}"

    spaced = lambda x, sign=" ": sign.join(x[i : i + 4] for i in range(0, len(x), 4))
    hexed, mixed = "0123456789abcdef", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    out: list[tuple[str, str | None]] = []
    for _ in range(12):
        out += [(t, "phone") for t in (f"call ({d(3)}) {d(3)}-{d(4)} now", f"tel {d(3)}-{d(3)}-{d(4)}", f"phone: 0{d(3)} {d(3)} {d(4)}", f"reach me at {d(3)}.{d(3)}.{d(4)} today", f"fax 00{d(2)} {d(2)} {d(4)} {d(4)}", f"mobile 0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"or ({d(3)}) {d(3)}-{d(4)}.")]
        out += [(t, "email") for t in (f"so {name()}[at]{host()}[dot]{top()} it is", f"{name()} [at] {host()} [dot] {top()}", f"and {name()} (at) {host()} (dot) {top()}.", f"write {name()} [at] {host()} [dot] {top()}", f"mail {name()}(at){host()}(dot){top()} now", f"{name()} @ {host()} . {top()}", f"contact {name()} at {host()} dot {top()}", f"to {name()}@{host()}.{top()} then")]
        out += [(t, "card") for t in (f"card {spaced(card(16))} please", f"visa {spaced(card(16), '-')}", f"mastercard {spaced(card(16), '.')} ok", f"paid by {card(16)} today", f"by amex {card(15)} today")]
        out += [(t, "account") for t in (f"iban {spaced(account('DE', d(18)))}", f"account {account('GB', 'ABCD' + d(14))} and", f"{spaced(account('FR', d(23)))} for rent")]
        out += [(t, "secret") for t in (f'x = "{some(hexed, 40)}"', f"y: {some(mixed, 32)}", f"z='{some(mixed, 24)}'", f"k={some(hexed, 32)}", f'id: "{some(mixed, 48)}"')]
        out += [(t, "ip") for t in (f"host fe80:{some(hexed, 4)}::{some(hexed, 4)}:{d(3)} up", "server " + ":".join(some(hexed, 4) for _ in range(8)))]
        out += [
            (t, None)
            for t in (
                f"on 20{d(2)}-0{d(1)}-1{d(1)} at noon", f"seen 1{d(1)}.0{d(1)}.20{d(2)} again", f"took 1{d(1)}:2{d(1)}:3{d(1)} in all", f"version {d(1)}.{d(2)}.{d(3)}.{d(2)}", f"sizes {d(3)} {d(3)} {d(3)}", f"pages {d(2)}-{d(2)}-{d(2)}", f"page {d(2)} of {d(3)}, line {d(4)}",
                f"is {d(2)} {d(3)} {d(3)} all told", f"commit {some(hexed, 40)} of the branch", f"see path/to/file_{d(3)}/and/more_of_it here", f"the some-long-word-{d(2)}-with-dashes-inside it", f"stopped at {host()} dot by dot", f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"sum {d(13)} units", f"range {d(4)}/{d(2)}/{d(2)} done", f"AB{d(2)} CD{d(2)} EF{d(2)} GH{d(2)} parts",
            )
        ]
    return out


def _calibration(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """The slope and shift that turn raw scores into probabilities, by Newton steps; ``a``, ``b``: weights for and against."""
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -30, 30)))
        d, w = p * (a + b) - a, p * (1 - p) * (a + b)
        grad = np.array([(d * raw).sum() + 0.1 * (slope - 1), d.sum() + 0.1 * shift])
        hess = np.array([[(w * raw * raw).sum() + 0.1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.1]])
        slope, shift = np.array([slope, shift]) - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return float(slope), float(shift)


class Boosted:
    """Boosted trees of depth three over binned features, fitted on weighted feature vectors, with calibration and thresholds."""

    def __init__(self) -> None:
        self.trees: list = []
        self.slope, self.shift = np.ones(len(GENERATORS)), np.zeros(len(GENERATORS))
        self.thresholds = [2.0] * len(GENERATORS)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        value = 0.3 * -g.sum() / (h.sum() + 1.0)
        if depth == 0 or len(x) < 2:
            return float(value)
        best = (1e-6, None, 0)
        for f, bins in enumerate(FEATURES.values()):
            a, b = (np.cumsum(np.bincount(x[:, f], weights=w, minlength=bins))[:-1] for w in (g, h))
            gain = a * a / (b + 1.0) + (g.sum() - a) ** 2 / (h.sum() - b + 1.0) - g.sum() ** 2 / (h.sum() + 1.0)
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
        _, f, v = best
        if f is None:
            return float(value)
        left = x[:, f] <= v
        return (f, v, self._grow(x[left], g[left], h[left], depth - 1), self._grow(x[~left], g[~left], h[~left], depth - 1))

    def _values(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        return np.where(x[:, tree[0]] <= tree[1], self._values(tree[2], x), self._values(tree[3], x))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum((self._values(t, x) for t in self.trees), np.zeros(len(x)))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope[x[:, 0]] * self.raw(x) + self.shift[x[:, 0]], -30, 30)))

    def fit(self, taught: tuple, held: tuple, least_precision: float, rounds: int = 40) -> None:
        """``taught``, ``held``: (feature vectors, weight of examples, weight of counter-examples of each)."""
        x, a, b = taught
        f = np.zeros(len(x))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
            self.trees.append(self._grow(x, p * (a + b) - a, p * (1 - p) * (a + b), 3))
            f = f + self._values(self.trees[-1], x)
        x, a, b = held
        raw = self.raw(x)
        for kind in range(len(GENERATORS)):
            own = x[:, 0] == kind
            self.slope[kind], self.shift[kind] = _calibration(raw[own], a[own], b[own])
        p = self.probabilities(x)
        for kind in range(len(GENERATORS)):
            own = np.flatnonzero((x[:, 0] == kind) & (p >= 0.5))
            own = own[np.argsort(-p[own], kind="stable")]
            right = np.cumsum(a[own]) >= least_precision * np.cumsum(a[own] + b[own])
            if right.any():
                last = np.flatnonzero(right)[-1]
                below = 0.5 if last == len(own) - 1 else float(p[own[last + 1]])
                self.thresholds[kind] = below if last == len(own) - 1 else (float(p[own[last]]) + below) / 2

    def column(self, f: Column) -> Column:
        """The calibrated probability as a column expression over a struct of features."""
        names = list(FEATURES)

        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(f[names[tree[0]]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        raw = F.aggregate(F.array(*[of(t) for t in self.trees]), F.lit(0.0), lambda s, v: s + v)
        slope, shift = (F.element_at(F.array(*[F.lit(float(v)) for v in own]), f["kind"] + 1) for own in (self.slope, self.shift))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), slope * raw + shift))))


def learn(found: DataFrame, least_precision: float) -> Boosted:
    """Fit on the histogram of labelled candidates, and as much weight of made ones for each kind.

    ``found``: rows (half, made, candidates), where ``made`` is null but for made examples.
    """
    each = found.select("half", "made", F.explode("candidates").alias("c"))
    kind = F.element_at(F.array(*[F.lit(k) for k in GENERATORS]), F.col("c.f.kind") + 1)
    label = F.when(F.col("made").isNull(), F.col("c.label")).when(kind == F.col("made"), 1).when(F.col("made") == "none", 0)
    counts = each.select("half", F.col("made").isNotNull().alias("made"), label.alias("label"), "c.f.*").where("label IS NOT NULL").groupBy("half", "made", "label", *FEATURES).agg(F.count("*").alias("n"))
    rows = [(r.half, r.made, r.label, [r[k] for k in FEATURES], float(r.n)) for r in counts.collect()]  # bounded by the product of the bins
    chance = [CHANCE.get(k, 1.0) for k in GENERATORS]
    rows = [(half, made, label, x, n * (chance[x[0]] if label == 0 and not made else 1.0)) for half, made, label, x, n in rows]
    total = lambda i, made: sum(n for _, m, _, x, n in rows if x[0] == i and m == made)
    weight = [max(1.0, total(i, False) / max(1.0, total(i, True))) for i in range(len(GENERATORS))]
    halves = []
    for half in (0, 1):
        own = [(label, x, n * (weight[x[0]] if made else 1.0)) for h, made, label, x, n in rows if h == half]
        x = np.array([r[1] for r in own], np.int64).reshape(-1, len(FEATURES))
        halves.append((x, np.array([r[2] * (r[0] == 1) for r in own]), np.array([r[2] * (r[0] == 0) for r in own])))
    model = Boosted()
    model.fit(*halves, least_precision)
    return model


def _kept(likely: Column) -> Column:
    """Of an array sorted by start, a sweep: of two that overlap the likelier, then the earlier stays."""

    def step(s: Column, c: Column) -> Column:
        last = F.try_element_at(s, F.lit(-1))
        apart = last.isNull() | (last["b"] <= c["a"])
        return F.when(apart, F.concat(s, F.array(c))).when(c["p"] > last["p"], F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(c))).otherwise(s)

    return F.aggregate(likely, F.array().cast("array<struct<a:int,b:int,kind:string,p:double>>"), step)


def added_spans(found: DataFrame, model: Boosted) -> DataFrame:
    """(of_row, added) for rows of ``found`` (row, base spans, candidates) to which spans are added."""
    failed = (F.col("c.label") == 0) & (F.col("c.f.kind") != list(GENERATORS).index("secret"))
    each = found.where(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c")).where(~F.coalesce(failed, F.lit(False))).select("row", "c.a", "c.b", "c.f")
    least = F.element_at(F.array(*[F.lit(t) for t in model.thresholds]), F.col("f.kind") + 1)
    kind = F.element_at(F.array(*[F.lit(k) for k in GENERATORS]), F.col("f.kind") + 1)
    likely = settled(each.withColumn("p", model.column(F.col("f")))).where(F.col("p") >= least).select("row", "a", "b", kind.alias("kind"), "p", F.lit(False).alias("base"))
    strict = found.select("row", F.inline(F.concat(*KINDS))).select("row", "a", "b", F.lit("").alias("kind"), F.lit(2.0).alias("p"), F.lit(True).alias("base"))
    own = Window.partitionBy("row")
    so_far = lambda *order: own.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(F.col("base"), F.col("b"))).over(so_far("a", F.desc("base")))
    behind = F.min(F.when(F.col("base"), F.col("a"))).over(so_far(F.desc("a"), F.desc("base")))
    free = likely.union(strict).withColumn("before", before).withColumn("behind", behind)
    free = free.where(~F.col("base") & (F.coalesce("before", F.lit(0)) <= F.col("a")) & (F.coalesce("behind", F.col("b")) >= F.col("b")))
    # clusters of candidates that overlap each other, swept one by one
    by_start = Window.partitionBy("row").orderBy("a", "b", "kind")
    furthest = F.max("b").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = free.withColumn("opens", (F.coalesce(furthest, F.lit(0)) <= F.col("a")).cast("int"))
    clusters = opened.withColumn("cluster", F.sum("opens").over(by_start)).groupBy("row", "cluster").agg(F.sort_array(F.collect_list(F.struct("a", "b", "kind", "p"))).alias("likely"))
    kept = clusters.select("row", F.inline(_kept(F.col("likely"))))
    added = F.transform(F.sort_array(F.collect_list(F.struct("a", "b", "kind", "p"))), lambda c: F.struct(c["kind"].alias("kind"), c["a"].alias("a"), c["b"].alias("b"), c["p"].alias("p")))
    return kept.groupBy(F.col("row").alias("of_row")).agg(added.cast(_ADDED).alias("added"))  # spans of one text


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_precision: float = 0.9) -> DataFrame:
    """One row per document: row, doc_id, an array of base spans for each kind, and ``added``.

    ``added`` has (kind, a, b, p): spans of the boosted trees, with their calibrated probability. ``row`` is
    the number that the row of ``docs`` had when it was read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.lit(None).cast("string").alias("made"), F.pmod(F.xxhash64(id_col), F.lit(2)).cast("int").alias("half"))
    examples = docs.sparkSession.createDataFrame([(t, k or "none", zlib.crc32(t.encode()) % 2) for t, k in made_examples()], "text string, made string, half int")
    both = rows.union(examples.select(F.lit(None).cast(rows.schema["doc_id"].dataType), "text", "made", "half"))
    every = staged(spans_and_candidates(both).select(F.monotonically_increasing_id().alias("row"), "*"), "spans")
    found, none = every.where("made IS NULL").drop("made", "half"), F.array().cast(_ADDED)
    if found.where(F.size("candidates") > 0).isEmpty():
        return found.select("row", "doc_id", *KINDS, none.alias("added"))
    added = added_spans(found, learn(every, least_precision))
    out = found.drop("candidates").join(added, F.col("row") == F.col("of_row"), "left")
    return out.select("row", "doc_id", *KINDS, F.coalesce("added", none).alias("added"))


def _ends(s: Column) -> Column:
    return F.struct(s["a"].alias("a"), s["b"].alias("b"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _written(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s["a"].cast("string"), s["b"].cast("string"))


def _of_kind(kind: str):
    return lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.lit(kind).alias("k"))


def span_list(with_added: bool) -> Column:
    """Spans as kind:start:end by kind as listed (the method's own kinds last), then start, comma-joined."""
    parts = [F.transform(k, _written(k)) for k in KINDS]
    if with_added:
        of = lambda k: F.transform(F.filter("added", _is(k)), _ends)
        both = {k: F.array_sort(F.concat(F.transform(k, _ends), of(k))) if k in KINDS else F.array_sort(of(k)) for k in (*KINDS, *MORE)}
        parts = [F.transform(own, _written(k)) for k, own in both.items()]
    return F.array_join(F.concat(*parts), ",")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id and text with every span replaced by its kind in angle brackets."""
    rows = staged(docs.select(F.monotonically_increasing_id().alias("no"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), "texts")
    found = personal_data(rows, "no", "text", **how)
    spans = F.concat(*[F.transform(k, _of_kind(k)) for k in KINDS], F.transform("added", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["kind"].alias("k"))))
    found = found.select(F.col("doc_id").alias("of_no"), F.array_sort(spans).alias("spans")).where(F.size("spans") > 0)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def step(s: Column, x: Column) -> Column:
        between = F.substring(text, s["at"] + 1, F.greatest(F.lit(0), x["a"] - s["at"]))
        mark = F.when(x["a"] >= s["at"], F.concat(F.lit("<"), x["k"], F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.greatest(s["at"], x["b"]).alias("at"), F.concat(s["out"], between, mark).alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    both = rows.join(found, F.col("no") == F.col("of_no"), "left")
    return both.select("doc_id", F.when(F.col("spans").isNotNull(), F.aggregate("spans", state, step, rest)).otherwise(text).alias("text"))
