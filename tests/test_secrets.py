"""Secrets in literals, over several of them too."""

import pytest

from tessera.operators.secrets import secrets

BEGIN, END = '"-----BEGIN RSA PRIVATE KEY-----"', '"-----END RSA PRIVATE KEY-----"'
CASES = [
    ("k = " + " +\n  ".join([BEGIN, *[f'"part{i}"' for i in range(8)], END]) + ';\npassword = "x";', ["0 key", "10 variable"]),
    (f'k = {BEGIN} + "abc"; pwd = "no";', []),
    (f'k = {BEGIN} + "" + "abc" + {END}; pwd = "yes";', ["4 variable"]),
    (f'k = {BEGIN} + {END} + "user=\'joe\'";', ["2 credential"]),
    (f'k = {BEGIN} + "a" + {BEGIN} + "b" + {END};', ["2 key"]),
    ('k = "-----BEGIN CERTIFICATE-----\\nMII\\n-----END CERTIFICATE-----"; uid = "u";', ["0 key", "1 variable"]),
    ('k = "-----BEGIN PRIVATE KEY-----  -----END PRIVATE KEY-----";', []),
    (f'// k = {BEGIN}\nuserName = "joe"; author = "x"; auth = " ";', ["0 variable"]),
    (END, []),
    ("", []),
    (None, []),
]


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(99, CASES[0][0]), (99, CASES[0][0])], "k int, text string").repartition(3)
    out = {}
    for r in secrets(files, "Java", "k").orderBy("place").collect():
        out.setdefault(r.k, []).append(f"{r.place} {r.kind}")
    assert secrets(files.limit(0), "Java", "k").count() == 0
    return out


@pytest.mark.parametrize("case", range(len(CASES)))
def test_secrets(found, case):
    assert found.get(case, []) == CASES[case][1]


def test_repeated_rows_stay_apart(found):
    assert found[99] == ["0 key", "0 key", "10 variable", "10 variable"]
