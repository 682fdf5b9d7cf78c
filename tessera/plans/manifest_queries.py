"""Queries over manifests, discovery files and nodes that are made from the tables' rows, and what they hold in SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dependencies as Dep
from tessera.operators import nodes as N
from tessera.sources import sinks
from tessera.sources.files import with_path_parts
from tessera.staging import dealt

#: The files of a part by its key modulo the number of kinds: names and texts, where {p} stands for the key, {v} for a version, {m} for its first number.
MANIFESTS: list[list[tuple[str, str]]] = [
    [("requirements.txt", "lib{p}=={v}\nother>=1.0 # why\n-r more.txt\n"), ("requirements-dev.txt", "pytest==8.0\n")],
    [("package.json", '{"name": "x", "dependencies": {"lib{p}": "^{v}"}, "devDependencies": {"jest": "29"}}'), ("bower.json", '{"dependencies": {"lost": "1.0"}}')],
    [("package-lock.json", '{"dependencies": {"lib{p}": {"version": "{v}", "dependencies": {"inner{p}": {"version": "1.{m}.0", "dependencies": {"deep{p}": {"version": "2.0.{m}"}}}}}, "mocha": {"version": "10.0.0", "dev": true}}}'), ("package.json", '{"dependencies": {"lib{p}": "*"}}')],
    [("go.mod", "module d\n\nrequire (\n\texample.org/lib{p} v{v}\n\texample.org/old{p} v1.0.0 // indirect\n)\n\nexclude (\n\texample.org/bad v0.1.0\n)\n\nreplace example.org/old{p} => example.org/new{p} v3.{m}.0\n")],
    [("go.sum", "example.org/lib{p} v{m}.9.0/go.mod h1:a=\nexample.org/lib{p} v{m}.10.0 h1:b=\n"), ("go.mod", "module e\nrequire example.org/lost v1.0.0\n")],
    [("composer.json", '{"require": {"php": ">=8", "a/lib{p}": "^2.0"}}'), ("composer.lock", '{"packages": [{"name": "a/lib{p}", "version": "v{v}"}]}')],
    [("Gemfile.lock", "GEM\n  specs:\n    lib{p} ({v})\n      inner (= 1.0)\n")],
    [("pom.xml", "<project><groupId>g{p}</groupId><artifactId>r</artifactId><version>1</version><properties><a>{v}</a><b>${a}</b></properties><dependencyManagement><dependencies><dependency><groupId>o</groupId><artifactId>man{p}</artifactId><version>7.{m}</version></dependency></dependencies></dependencyManagement></project>"), ("m/pom.xml", "<project><parent><groupId>g{p}</groupId><artifactId>r</artifactId><version>1</version></parent><artifactId>m</artifactId><dependencies><dependency><groupId>o</groupId><artifactId>lib{p}</artifactId><version>${b}.${a}</version><scope>test</scope></dependency><dependency><groupId>o</groupId><artifactId>man{p}</artifactId></dependency></dependencies></project>")],
    [("build.gradle", "def ver = '{v}'\next.libs = [\n  one: 'o:lib{p}:1.{m}',\n]\ndependencies {\n  implementation 'o:str{p}:$ver'\n  compile group: 'o', name: 'map{p}', version: '{v}'\n  testImplementation libs.one\n}\n")],
    [("a.csproj", '<Project><PackageReference Include="Att{p}" Version="{v}" />\n<PackageReference Include="Ele{p}">\n  <Version>1.{m}</Version>\n</PackageReference></Project>')],
    [("poetry.lock", '[[package]]\nname = "lib{p}"\nversion = "{v}"\n'), ("pyproject.toml", '[tool.poetry.dependencies]\nlost = "^1"\n')],
    [("pyproject.toml", '[tool.poetry.dependencies]\npython = "^3.9"\nlib{p} = "^{v}"\n')],
    [("setup.py", 'setup(install_requires=["lib{p}>={v}"])')],
    [("build.xml", '<path><pathelement location="lib/lib{p}-{v}.jar"/></path>')],
    [("s.R", "library(lib{p})\nlibrary(lib{p})\n")],
    [("package.json", '{"dependencies": {"lib{p}": "^1.0"}}'), ("yarn.lock", 'lib{p}@^1.0:\n  version "{v}"\n')],
]


def _made(template: str) -> Column:
    m = F.col("p_size").cast("string")
    values = {"{p}": F.col("p_partkey").cast("string"), "{v}": F.concat_ws(".", m, (F.col("p_partkey") % 13).cast("string"), (F.col("p_partkey") % 7).cast("string")), "{m}": m}
    return F.concat(*[values[x] if x in values else F.lit(x) for x in re.split(r"(\{[pvm]\})", template) if x])


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, dir, name, ext, text): the files of each part."""
    own = F.array()
    for k, files in enumerate(MANIFESTS):
        made = F.array(*[F.struct(F.lit(n).alias("n"), _made(t).alias("text")) for n, t in files])
        own = F.when(F.col("p_partkey") % len(MANIFESTS) == k, made).otherwise(own) if k else F.when(F.col("p_partkey") % len(MANIFESTS) == 0, made)
    each = dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")).select("p_partkey", F.inline(own))
    return with_path_parts(each.select(F.concat(F.lit("/p"), F.col("p_partkey").cast("string"), F.lit("/"), F.col("n")).alias("path"), "text"))


def q25_dependency_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of manifests of sixteen kinds, made from parts."""
    return Dep.inventory(manifests(spark, sf_dir)).select("path", "techno", "name", "version", "low", "high", "environment")


_V = "m || '.' || p % 13 || '.' || p % 7"
#: (kind, file, technology, name, version, low, high, environment), as SQL over p and m; null versions are open.
_EXPECTED = [
    (0, "requirements.txt", "Python", "'lib' || p", f"'==' || {_V}", _V, _V, "prod"), (0, "requirements.txt", "Python", "'other'", "'>=1.0'", "'1.0'", "NULL", "prod"),
    (1, "package.json", "JS", "'lib' || p", f"'^' || {_V}", _V, "m || '.x'", "prod"),
    (2, "package-lock.json", "JS", "'lib' || p", _V, _V, _V, "prod"), (2, "package-lock.json", "JS", "'inner' || p", "'1.' || m || '.0'", "'1.' || m || '.0'", "'1.' || m || '.0'", "prod"), (2, "package-lock.json", "JS", "'deep' || p", "'2.0.' || m", "'2.0.' || m", "'2.0.' || m", "prod"),
    (3, "go.mod", "Go", "'example.org/lib' || p", _V, _V, _V, "prod"), (3, "go.mod", "Go", "'example.org/new' || p", "'3.' || m || '.0'", "'3.' || m || '.0'", "'3.' || m || '.0'", "prod"),
    (4, "go.sum", "Go", "'example.org/lib' || p", "m || '.10.0'", "m || '.10.0'", "m || '.10.0'", "prod"),
    (5, "composer.json", "PHP", "'a/lib' || p", _V, _V, _V, "prod"),
    (6, "Gemfile.lock", "Ruby", "'lib' || p", _V, _V, _V, "prod"),
    (7, "m/pom.xml", "Java", "'o:lib' || p", f"{_V} || '.' || {_V}", f"{_V} || '.' || {_V}", f"{_V} || '.' || {_V}", "test"), (7, "m/pom.xml", "Java", "'o:man' || p", "'7.' || m", "'7.' || m", "'7.' || m", "prod"),
    (8, "build.gradle", "Java", "'o:str' || p", _V, _V, _V, "prod"), (8, "build.gradle", "Java", "'o:map' || p", _V, _V, _V, "prod"), (8, "build.gradle", "Java", "'o:lib' || p", "'1.' || m", "'1.' || m", "'1.' || m", "test"),
    (9, "a.csproj", "CS", "'Att' || p", _V, _V, _V, "prod"), (9, "a.csproj", "CS", "'Ele' || p", "'1.' || m", "'1.' || m", "'1.' || m", "prod"),
    (10, "poetry.lock", "Python", "'lib' || p", _V, _V, _V, "prod"),
    (11, "pyproject.toml", "Python", "'lib' || p", f"'^' || {_V}", _V, "m || '.x'", "prod"),
    (12, "setup.py", "Python", "'lib' || p", f"'>=' || {_V}", _V, "NULL", "prod"),
    (13, "build.xml", "Java", "'lib' || p", _V, _V, _V, "prod"),
    (14, "s.R", "R", "'lib' || p", "NULL", "NULL", "NULL", "prod"),
    (15, "package.json", "JS", "'lib' || p", _V, _V, _V, "prod"),
]
_INVENTORY = "WITH k AS (SELECT p_partkey AS p, p_size AS m FROM part)\n" + "\nUNION ALL ".join(
    f"SELECT '/p' || p || '/{file}' AS path, '{techno}' AS techno, {name} AS name, ({version})::VARCHAR AS version, ({low})::VARCHAR AS low, ({high})::VARCHAR AS high, '{env}' AS environment FROM k WHERE p % {len(MANIFESTS)} = {kind}"
    for kind, file, techno, name, version, low, high, env in _EXPECTED
)
Q25 = _INVENTORY


def q25b_merged_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and environments of each technology's dependencies in the inventory, by the first letters of their names."""
    found = q25_dependency_inventory(spark, sf_dir).withColumn("name", F.regexp_extract("name", "^[A-Za-z:./]+", 0))
    return Dep.merged(found.withColumn("low", F.lit(None).cast("string")).withColumn("high", F.lit(None).cast("string"))).select("techno", "name", "environments", "files")


Q25B = f"""
WITH i AS ({_INVENTORY}), n AS (SELECT techno, regexp_extract(name, '^[A-Za-z:./]+') AS name, environment FROM i)
SELECT techno, min(name) AS name, string_agg(DISTINCT environment, ',' ORDER BY environment) AS environments, count(*) AS files FROM n GROUP BY techno, lower(name)
"""


def q36_selected_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule whose selector fits a manifest's name as a whole, first match wins."""
    rules = spark.createDataFrame([(0, "locks", r".*[.]lock|go[.]sum|package-lock[.]json"), (1, "json", r".*[.]json"), (2, "build", r"build[.].*|pom[.]xml"), (3, "requirements", r"requirements"), (4, "other", r".*[.](?:txt|toml|py|R|mod|csproj)")], "ordinal int, name string, pattern string")
    return Dep.by_selectors(manifests(spark, sf_dir).select("path", "name"), rules).groupBy("rule").agg(F.count("*").alias("files"))


_FILES_SQL = "WITH f AS (" + " UNION ALL ".join(f"SELECT '{n.rsplit('/', 1)[-1]}' AS name FROM part WHERE p_partkey % {len(MANIFESTS)} = {k}" for k, files in enumerate(MANIFESTS) for n, _ in files) + ")"
Q36 = rf"""
{_FILES_SQL}
SELECT CASE WHEN regexp_full_match(name, '.*[.]lock|go[.]sum|package-lock[.]json') THEN 'locks' WHEN regexp_full_match(name, '.*[.]json') THEN 'json' WHEN regexp_full_match(name, 'build[.].*|pom[.]xml') THEN 'build'
  WHEN name = 'requirements' THEN 'requirements' WHEN regexp_full_match(name, '.*[.](?:txt|toml|py|R|mod|csproj)') THEN 'other' END AS rule, count(*) AS files FROM f GROUP BY 1
"""


def q37_maven_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maven's dependency elements as path-numbered rows, normal or managed."""
    return sinks.maven_rows(Dep.maven_declared(Dep.maven_projects(manifests(spark, sf_dir))))


Q37 = """
WITH k AS (SELECT p_partkey AS p, p_size AS m FROM part WHERE p_partkey % 16 = 7),
d AS (SELECT '/p' || p || '/pom.xml' AS path, 1 AS place, 'managed;o;man' || p || ';7.' || m || ';-1' AS rest FROM k
  UNION ALL SELECT '/p' || p || '/m/pom.xml', 1, 'normal;o;lib' || p || ';${b}.${a};test' FROM k UNION ALL SELECT '/p' || p || '/m/pom.xml', 2, 'normal;o;man' || p || ';-1;-1' FROM k)
SELECT path, place::INT AS place, path || ';' || place || ';' || rest AS line FROM d
"""

#: A Python source of a part: {i} nested conditions in a method, and a function of as many parameters.
_LEVELS = 4


def python_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a class whose method nests p_partkey mod 4 conditions, and a function behind it."""
    depth = (F.col("p_partkey") % _LEVELS).cast("int")
    levels = F.sequence(F.lit(1), depth)
    nested = F.when(depth > 0, F.array_join(F.transform(levels, lambda i: F.concat(F.repeat(F.lit("    "), i + 1), F.lit("if a:\n"))), "")).otherwise(F.lit(""))
    arguments = F.array_join(F.transform(F.sequence(F.lit(0), depth), lambda i: F.concat(F.lit("a"), i.cast("string"))), ", ")
    text = F.concat(F.lit("class C"), F.col("p_partkey").cast("string"), F.lit(":\n    def f(self):\n"), nested, F.repeat(F.lit("    "), depth + 2), F.lit("pass\n\ndef g("), arguments, F.lit("):\n    return 1\n"))
    return dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")).select(F.concat(F.lit("/s/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), text.alias("text"))


def q27_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of sources made from parts, with their parents and nesting."""
    return N.nodes(python_sources(spark, sf_dir), "Python", "path").select("path", "node_id", "parent_id", "kind", "name", "nesting", "last_line")


_NODES = """
WITH k AS (SELECT '/s/' || p_partkey || '.py' AS path, p_partkey AS p, (p_partkey % 4)::INT AS d FROM part)
SELECT path, 1 AS node_id, NULL::INT AS parent_id, 'class' AS kind, 'C' || p AS name, 0 AS nesting, d + 4 AS last_line FROM k
UNION ALL SELECT path, 2, 1, 'function', 'f', 1, d + 4 FROM k
UNION ALL SELECT path, (i + 2)::INT, (i + 1)::INT, 'if', NULL, (i + 1)::INT, d + 4 FROM k, range(1, 4) r(i) WHERE i <= d
UNION ALL SELECT path, d + 5, NULL, 'function', 'g', 0, d + 6 FROM k
"""
Q27 = f"SELECT path, node_id::INT AS node_id, parent_id, kind, name, nesting::INT AS nesting, last_line::INT AS last_line FROM ({_NODES})"


def q27b_node_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that need nodes, for sources made from parts."""
    return N.node_metrics(N.nodes(python_sources(spark, sf_dir), "Python", "path"), "path", long_function=4, many_parameters=3, deep=3).select("path", "n_function", "n_class", "n_if", "long_functions", "many_parameters", "deep_nodes", "max_nesting", "function_lines_average")


Q27B = """
SELECT '/s/' || p_partkey || '.py' AS path, 2::BIGINT AS n_function, 1::BIGINT AS n_class, d::BIGINT AS n_if, (CASE WHEN d + 3 > 4 THEN 1 ELSE 0 END)::BIGINT AS long_functions, (CASE WHEN d + 1 > 3 THEN 1 ELSE 0 END)::BIGINT AS many_parameters,
  greatest(0, d - 1)::BIGINT AS deep_nodes, (d + 1)::INT AS max_nesting, (d + 3 + 2) / 2 AS function_lines_average
FROM (SELECT p_partkey, (p_partkey % 4)::INT AS d FROM part)
"""


def q38_kept_and_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that are written (cause class 1 or 2), as one section in order of a number."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", (F.col("p_partkey") % 4).cast("int").alias("cause_class"))
    return sinks.section_lines(sinks.kept_results(part), "kept", ["p_partkey", "p_size", "cause_class"], ["p_size", "p_partkey"])


Q38 = """
SELECT 'kept' AS section, 0 AS part, '' AS place, 'section=kept' AS line UNION ALL SELECT 'kept', 1, '', 'p_partkey;p_size;cause_class'
UNION ALL SELECT 'kept', 2, lpad(p_size::VARCHAR, 20, '0') || chr(1) || lpad(p_partkey::VARCHAR, 20, '0'), p_partkey || ';' || p_size || ';' || p_partkey % 4 FROM part WHERE p_partkey % 4 IN (1, 2)
"""

_QUERIES = {
    "q25_dependency_inventory": (q25_dependency_inventory, Q25),
    "q25b_merged_inventory": (q25b_merged_inventory, Q25B),
    "q27_nodes": (q27_nodes, Q27),
    "q27b_node_metrics": (q27b_node_metrics, Q27B),
    "q36_selected_dependencies": (q36_selected_dependencies, Q36),
    "q37_maven_rows": (q37_maven_rows, Q37),
    "q38_kept_and_sorted": (q38_kept_and_sorted, Q38),
}


def queries() -> dict:
    return {name: run for name, (run, _) in _QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _QUERIES.items()}
