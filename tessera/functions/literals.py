"""Findings in string literals: addresses, paths, links, credentials, tokens.

Each function takes a literal with its quotes and gives a boolean column, false for null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import entropy

#: Root directories that make a Unix path.
ROOTS = "bin boot dev etc home lib lib64 mnt opt proc root run srv sys tmp usr var".split()
#: Words that make a name one of a namespace, and names whose values are secret.
NAMESPACES = ["qname", "namespace", "namespaces", "ns", "xmlns"]
SECRET_NAMES = ["password", "pwd", "user", "username", "uid", "auth", "db", "database", "account"]
LEAST_TOKEN, LEAST_ENTROPY, OCTET_OVER = 20, 4.5, 10


def _inner(s: Column) -> Column:
    """A literal without the quotes around it; null if it isn't quoted."""
    return F.when(F.rlike(s, F.lit(r"(?s)^[\"'].*[\"']$")) & (F.length(s) >= 2), F.substring(s, F.lit(2), F.length(s) - 2))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _every(parts: Column, pattern: str) -> Column:
    return F.forall(parts, lambda p: F.rlike(p, F.lit(pattern)))


def _address(s: Column) -> Column:
    """What an address literal holds, without brackets and what stands behind them or a slash."""
    own = _inner(s)
    return F.regexp_replace(F.regexp_replace(own, r"/[0-9]+$", ""), r"^\[([^\]]*)\](?::[0-9]+)?$", "$1")


def is_ipv4(s: Column) -> Column:
    """Four parts of one to three digits between dots, one of the first three over 10 (smaller ones are taken for version numbers)."""
    parts = F.split(_address(s), r"\.")
    numbers = F.when((F.size(parts) == 4) & _every(parts, r"^[0-9]{1,3}$"), F.slice(parts, 1, 3))
    return _true(F.exists(numbers, lambda p: p.cast("int") > OCTET_OVER))


def is_ipv6(s: Column) -> Column:
    """Eight groups of up to four hexadecimal digits between colons, or fewer with one gap inside; a dotted tail stands for two groups."""
    own = F.regexp_replace(_address(s), r"(?<=:)[0-9]{1,3}(?:\.[0-9]{1,3}){3}$", "0:0")
    parts = F.split(own, ":")
    gaps = F.size(F.filter(parts, lambda p: p == ""))
    ends = (F.element_at(parts, 1) != "") & (F.element_at(parts, -1) != "")
    return _true(_every(parts, r"^[0-9A-Fa-f]{0,4}$") & ends & (((gaps == 0) & (F.size(parts) == 8)) | ((gaps == 1) & F.size(parts).between(3, 8))))


def is_ip(s: Column) -> Column:
    return is_ipv4(s) | is_ipv6(s)


def is_path(s: Column) -> Column:
    """A drive, share or known root with segments of plain signs behind it, and three letters in a row somewhere."""
    own = F.replace(F.regexp_replace(_inner(s), r"(?i)^file:[/\\]+(?=[a-z]:)", ""), F.lit("\\"), F.lit("/"))
    own = F.regexp_replace(own, r"(?i)^file:/+", "/")
    parts = F.filter(F.split(own, "/"), lambda p: p != "")
    head = F.element_at(F.split(own, "/"), 1)
    drive = F.rlike(head, F.lit(r"^[A-Za-z]:$")) & (F.size(parts) > 1)
    share = F.contains(s, F.lit("\\")) & F.startswith(own, F.lit("/")) & (F.size(parts) > 0)
    root = F.startswith(own, F.lit("/")) & F.lower(F.try_element_at(parts, F.lit(1))).isin(*ROOTS)
    plain = F.forall(F.when(drive, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts), lambda p: F.rlike(p, F.lit(r"^[\w .\-]+$")))
    return _true((drive | share | root) & plain & F.rlike(own, F.lit("[A-Za-z]{3}")))


def _scheme(s: Column) -> Column:
    return F.lower(F.regexp_extract(_inner(s), r"^([A-Za-z]+)://", 1))


def _names_namespace(s: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(s), r"\W+"), F.array(*[F.lit(n) for n in NAMESPACES]))


def is_url(s: Column) -> Column:
    return _true(_scheme(s).isin("http", "https") & ~_names_namespace(s))


def insecure_scheme(s: Column) -> Column:
    """http or ftp for a literal that is a link without encryption, else null; schemas' hosts are none."""
    host = F.lower(F.regexp_extract(_inner(s), r"^[A-Za-z]+://([\w.\-]*)", 1))
    return F.when(_scheme(s).isin("http", "ftp") & (host != "www.w3.org") & ~_names_namespace(s), _scheme(s))


def is_credential(s: Column) -> Column:
    """A secret name with a quoted value that isn't blank behind its equals sign."""
    pattern = F.lit(r"(\w+)\s*=\s*\\?[\"']+([^\\\"']*)\\?[\"']")
    pairs = F.arrays_zip(F.regexp_extract_all(s, pattern, F.lit(1)).alias("n"), F.regexp_extract_all(s, pattern, F.lit(2)).alias("v"))
    return _true(F.exists(pairs, lambda x: F.lower(x["n"]).isin(*SECRET_NAMES) & (F.trim(x["v"]) != "")))


def is_secret_assignment(name: Column, value: Column) -> Column:
    """A variable with a secret name that is given a literal that isn't blank."""
    words = F.split(F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "_")), r"[^a-z0-9]+")
    return _true(F.arrays_overlap(words, F.array(*[F.lit(n) for n in SECRET_NAMES])) & (F.trim(_inner(value)) != ""))


def is_key_block(s: Column) -> Column:
    """A PEM block of a private key or certificate with something in it."""
    kind = F.regexp_extract(s, r"BEGIN\s+([A-Z ]+?)\s*-", 1)
    body = F.regexp_replace(F.regexp_extract(s, r"(?s)BEGIN\s+[A-Z ]+?\s*-+(.*?)-+\s*END\b", 1), r"[\s\-]+", "")
    return _true((F.endswith(kind, F.lit("PRIVATE KEY")) | F.endswith(kind, F.lit("CERTIFICATE"))) & (body != ""))


def is_token(s: Column) -> Column:
    """A web token: two or three parts between dots, 20 characters at least, letters and digits, over 4.5 bits a character."""
    own = F.regexp_replace(s, r"^[\"']|[\"']$", "")
    parts = F.split(own, r"\.")
    shape = F.startswith(own, F.lit("eyJ")) & F.size(parts).between(2, 3) & _every(parts, r"^[\w\-=]+$") & (F.length(own) >= LEAST_TOKEN)
    return _true(F.when(shape & F.rlike(own, F.lit("[A-Za-z]")) & F.rlike(own, F.lit("[0-9]")), entropy(own) > LEAST_ENTROPY))


FINDINGS = {
    "HardCodedIP": is_ip,
    "HardCodedPath": is_path,
    "HTTPProtocol": is_url,
    "URINotSecuredHTTP": lambda s: F.coalesce(insecure_scheme(s) == "http", F.lit(False)),
    "URINotSecuredFTP": lambda s: F.coalesce(insecure_scheme(s) == "ftp", F.lit(False)),
    "SensitiveDataString": lambda s: is_credential(s) | is_key_block(s) | is_token(s),
}


def finding_counts(literals: Column) -> dict[str, Column]:
    """The number of literals of each kind of finding."""
    return {name: F.size(F.filter(literals, rule)).cast("bigint") for name, rule in FINDINGS.items()}
