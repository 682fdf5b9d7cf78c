"""Packages of R scripts, with what variables hold."""

import pytest

from tessera.operators.r_packages import r_packages

CASES = [
    ('pkgs <- c("a", \'b\')\nfor (p in pkgs) library(p, character.only=TRUE)', {"a", "b"}),
    ('library(p, character.only = TRUE)\np <- "late"', set()),
    ('p <- "old"\nq <- p\np <- "new"\nlibrary(q, character.only = TRUE)', {"old"}),
    ('for (p in c("x", "y")) {\n  require(p)\n}\nlibrary(z)', {"x", "y", "z"}),
    ('lapply(c("m", "n"), library, character.only = TRUE); sapply(u, require)', {"m", "n"}),
    ('f <- function(pkg, ...) {\n  if (!require(pkg, character.only = TRUE)) install.packages(pkg)\n}\nf("one")\nmore <- c("two", "three")\nlapply(more, f)', {"one", "two", "three"}),
    ("# library(no)\nx <- 'library(text)'\nsuppressMessages(library(yes))", {"yes"}),
    ("p_load(a1, \"b1\", c1)\ninstall_load('d1', 'e1')", {"a1", "b1", "c1", "d1", "e1"}),
    ('a <- b\nb <- a\nlibrary(a, character.only=T)', set()),
    ('library("g", lib.loc = "no")\nrequireNamespace("h", quietly = TRUE)', {"g", "h"}),
    ('library(data.table); library("Rcpp")', {"data.table", "Rcpp"}),
    ("", set()),
    (None, set()),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(CASES)], "path string, text string").repartition(3)
    out = {}
    for r in r_packages(rows).collect():
        out.setdefault(int(r.path), set()).add(r.package)
    return out


@pytest.mark.parametrize("case", range(len(CASES)))
def test_packages(found, case):
    assert found.get(case, set()) == CASES[case][1]


def test_long_chains_and_empty_tables(spark):
    text = 'v0 <- c("deep")\n' + "\n".join(f"v{i + 1} <- v{i}" for i in range(12)) + "\nlibrary(v12, character.only = TRUE)"
    files = spark.createDataFrame([("a", text), ("a", "library(twice)")], "path string, text string")
    assert {r.package for r in r_packages(files).collect()} == {"deep", "twice"} and r_packages(files.limit(0)).count() == 0
