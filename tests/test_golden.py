"""Results of the keyword scan against files of expected results, if a folder with some is named.

``KEYWORD_GOLDEN`` names a folder with specifications (``*.xml``), the expected files beside them (same name, ``.csv``) and
the sources that they name.
"""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import keyword_scan as K
from tessera.operators import metrics as M

FOLDER = Path(os.environ.get("KEYWORD_GOLDEN", "/nonexistent"))


def table(lines, title):
    """The rows of a section as dictionaries."""
    at = lines.index(title)
    rows = []
    for line in lines[at + 1 :]:
        if not line.strip():
            break
        rows.append(line.rstrip(";").split(";"))
    return [dict(zip(rows[0], r)) for r in rows[1:]]


@pytest.mark.skipif(not FOLDER.is_dir(), reason="no folder of expected results")
@pytest.mark.parametrize("spec", sorted(FOLDER.glob("*.xml")), ids=lambda p: p.stem)
def test_expected_results(spark, spec):
    lines = [x.rstrip("\r") for x in spec.with_suffix(".csv").read_text(encoding="utf-8-sig").split("\n")]
    (scan,) = K.read_scans(spec.read_text(encoding="utf-8-sig"))
    for want in table(lines, "FILE SECTION"):
        name = want["Dat_FileName"].split("/")[-1]
        files = spark.createDataFrame([(name, (FOLDER / name).read_bytes().decode("latin-1"))], "name string, text string")
        if any(g.items for g in scan.groups):
            cut = M.with_views(files, "Cobol")
            views = {"all": F.col("views.text"), "code": F.col("views.code"), "comment": F.col("views.comment"), "string": F.array_join("views.strings", "\n")}
            got = K.keyword_counts(cut, scan, views, ["name"]).first().asDict()
        else:
            got = {k: str(v).upper() for k, v in K.pattern_results(files, scan, F.col("text"), F.col("name"), ["name"]).first().asDict().items()}
        assert {k: str(got[k]) for k in want if not k.startswith("Dat_")} == {k: v for k, v in want.items() if not k.startswith("Dat_")}
