"""Which manifests of a directory count, and what a line of them says."""

from tessera.operators import dependencies as Dep
from tessera.sources.files import with_path_parts


def found(spark, *files):
    rows = with_path_parts(spark.createDataFrame(list(files), "path string, text string"))
    return {(r.dir, r.name, r.version) for r in Dep.inventory(rows).collect()}


def test_a_lock_file_counts_whatever_it_holds(spark):
    dev = '{"dependencies": {"jest": {"version": "1.0", "dev": true}}}'
    loose = '{"dependencies": {"x": "^1.0"}}'
    assert found(spark, ("/a/package-lock.json", dev), ("/a/package.json", loose), ("/b/package.json", loose), ("/c/.bower.json", loose), ("/d/bower.json", loose), ("/d/package.json", '{"name": "y"}')) == {("/b", "x", "^1.0"), ("/c", "x", "^1.0")}
    assert found(spark, ("/a/requirements-dev.txt", "pytest==8\n"), ("/a/requirements.txt", "b==1.0 --hash=sha256:x \\\n  --hash=sha256:y\nc>=2 ; python_version < '3'\n--index-url z\nd==1 # e\n")) == {("/a", "b", "==1.0"), ("/a", "c", ">=2"), ("/a", "d", "==1")}


def test_yarn_versions_are_those_of_the_nearest_directory(spark):
    lock = lambda v: f'x@^1.0:\n  version "{v}"\n'
    loose = '{"dependencies": {"x": "^1.0"}}'
    files = [("/other/yarn.lock", lock("9.0")), ("/d/yarn.lock", lock("1.1")), ("/d/e/yarn.lock", lock("1.2"))]
    files += [(f"/{p}/package.json", loose) for p in ("d", "d/e", "d/e/f", "d/g", "h")]
    assert found(spark, *files) == {("/d", "x", "1.1"), ("/d/e", "x", "1.2"), ("/d/e/f", "x", "1.2"), ("/d/g", "x", "1.1"), ("/h", "x", "^1.0")}


def test_local_replacements_are_no_dependencies(spark):
    text = "module m\nrequire (\n\ta.org/x v1.0.0\n\ta.org/y v1.0.0\n\ta.org/z v1.0.0\n)\nreplace a.org/x => ../x\nreplace a.org/y => a.org/w v2.0.0\n"
    assert found(spark, ("/a/go.mod", text)) == {("/a", "a.org/w", "2.0.0"), ("/a", "a.org/z", "1.0.0")}


def test_files_are_scanned_once(spark, tmp_path):
    rows = with_path_parts(spark.createDataFrame([("/a/package.json", '{"dependencies": {"x": "1"}}'), ("/a/pom.xml", "<project/>"), ("/a/big.txt", "no")], "path string, text string"))
    rows.write.parquet(f"{tmp_path}/files")
    plan = Dep.inventory(spark.read.parquet(f"{tmp_path}/files"))._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp_path}/files" not in plan and "tessera-manifests" in plan


POM = """<?xml version="1.0"?>
<!-- <dependency><groupId>no</groupId></dependency> -->
<m:project xmlns:m="http://maven.apache.org/POM/4.0.0" a="b">
  <m:version>3</m:version><m:artifactId> art </m:artifactId><m:groupId>g &amp; h</m:groupId>
  <m:properties><v.x>1.<!-- in between -->5</v.x><m:w><![CDATA[2.0]]></m:w></m:properties>
  <m:dependencies>
    <m:dependency><m:version>${v.x}</m:version><m:exclusions><m:exclusion><m:artifactId>ex</m:artifactId><m:groupId>no</m:groupId></m:exclusion></m:exclusions><m:artifactId>one</m:artifactId><m:groupId>o</m:groupId></m:dependency>
    <!-- <m:dependency><m:groupId>o</m:groupId><m:artifactId>out</m:artifactId></m:dependency> -->
    <m:dependency><m:groupId>o</m:groupId><m:scope>test</m:scope><m:artifactId>two</m:artifactId><m:version>${w}</m:version></m:dependency>
  </m:dependencies>
  <m:build><m:plugins><m:plugin><m:dependencies><m:dependency><m:groupId>p</m:groupId><m:artifactId>plug</m:artifactId></m:dependency></m:dependencies></m:plugin></m:plugins></m:build>
  <m:profiles><m:profile><m:dependencies><m:dependency><m:groupId>o</m:groupId><m:artifactId>pro</m:artifactId><m:version>7</m:version></m:dependency></m:dependencies></m:profile></m:profiles>
</m:project>"""
PROJ = """<Project Sdk="x"><!-- <PackageReference Include="No" Version="1"/> -->
<ItemGroup Condition="a"><PackageReference Version="1.0" PrivateAssets="all" Include="A.B"/><PackageReference Include='C'><PrivateAssets/><Version> 2.0 </Version></PackageReference></ItemGroup>
<ItemGroup><Compile Include="x.cs"/></ItemGroup><Choose><When Condition="b"><ItemGroup><PackageReference Include="D" Version="3"/></ItemGroup></When></Choose></Project>"""
BOM = '<?xml version="1.0"?><b:bom xmlns:b="http://cyclonedx.org/schema/bom/1.3"><b:dependencies><!-- <dependency ref="no:no@1"/> --><b:dependency x="y" ref="g:a@1.0"><b:dependency ref="g:b@2"/></b:dependency><b:dependency ref="h:c"/></b:dependencies></b:bom>'


def test_xml_is_read_as_xml(spark):
    """Namespaces, comments, CDATA, attributes and elements in any order; broken documents give no rows."""
    files = [("/a/pom.xml", POM), ("/b/pom.xml", "<project><dependencies><dependency><groupId>x</groupId>"), ("/c/pom.xml", "<project/>"), ("/d/pom.xml", None), ("/e/p.csproj", PROJ), ("/f/p.vbproj", "<Project"), ("/g/build.xml", '<path><!-- lib/no-1.0.jar --><x location="lib/yes-2.0.jar"/></path>')]
    assert found(spark, *files) == {("/a", "o:one", "1.5"), ("/a", "o:two", "2.0"), ("/a", "o:pro", "7"), ("/e", "A.B", "1.0"), ("/e", "C", "2.0"), ("/e", "D", "3"), ("/g", "yes", "2.0")}
    rows = with_path_parts(spark.createDataFrame([("/a/bom.xml", BOM), ("/b/bom.xml", "<bom><dependencies>")], "path string, text string"))
    assert {(r.ref, r.group, r.artifact, r.version) for r in Dep.cyclonedx(rows).collect()} == {("g:a@1.0", "g", "a", "1.0"), ("g:b@2", "g", "b", "2"), ("h:c", "h", "c", None)}
    project = Dep.maven_projects(rows.limit(0).union(with_path_parts(spark.createDataFrame([("/a/pom.xml", POM)], "path string, text string")))).first()
    assert (project.group, project.artifact, project.version) == ("g & h", "art", "3")


CATALOG = '[versions]\nktor = "2.3"\n# no = "1"\n[libraries]\nktor-core = { module = "io.ktor:core", version.ref = "ktor" }\nlog_api = { group = "org.log", name = "api", version = "1.1" }\nold = "a:b:0.9"\nbom = { module = "c:bom", version = "5" }\n[plugins]\nx = { id = "y", version = "1" }\n'
BUILD = "dependencies {\n  implementation(libs.ktor.core)\n  testImplementation libs.log.api\n  api platform(libs.bom)\n  implementation libs.old\n  implementation platform('d:bom:7')\n  compile libs.unknown\n}\n"
PYPROJECT = '[project]\nname = "x"\ndependencies = ["a>=1"]\n[project.optional-dependencies]\nplot = ["b[c]>=2; x", \'d\']\n[dependency-groups]\ntest = [\n  "e==3",\n]\n[tool.poetry.group.docs.dependencies]\nf = "^4"\npython = "^3"\n[tool.poetry.dev-dependencies]\ng = { version = "5" }\n'


def test_catalogs_platforms_and_groups(spark):
    files = [("/r/gradle/libs.versions.toml", CATALOG), ("/r/app/build.gradle.kts", BUILD), ("/other/build.gradle", BUILD), ("/r/app/gradle/libs.versions.toml", '[libraries]\nold = "a:b:1.0"\n'), ("/p/pyproject.toml", PYPROJECT)]
    rows = with_path_parts(spark.createDataFrame(files, "path string, text string"))
    got = {(r.dir, r.name, r.version, r.environment) for r in Dep.inventory(rows).collect()}
    java = {("/r/app", "io.ktor:core", "2.3", "prod"), ("/r/app", "org.log:api", "1.1", "test"), ("/r/app", "c:bom", "5", "prod"), ("/r/app", "a:b", "1.0", "prod"), ("/r/app", "d:bom", "7", "prod"), ("/other", "d:bom", "7", "prod")}
    python = {("/p", "a", ">=1", "prod"), ("/p", "b", ">=2", "plot"), ("/p", "d", None, "plot"), ("/p", "e", "==3", "test"), ("/p", "f", "^4", "docs"), ("/p", "g", "5", "dev")}
    assert got == java | python
