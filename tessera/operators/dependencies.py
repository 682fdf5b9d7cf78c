r"""Dependencies from manifests: one row for each named dependency of each file.

Every reader takes a file table (path, dir, name, text) and gives (path, dir, techno, name, version, low,
high, environment): regular formats by regex and split, JSON by ``from_json``, XML by ``from_xml`` with a schema.
``inventory`` scans the files once, for those that are manifests by name, writes these, reads each format from them
and applies each directory's precedences; ``merged`` folds the inventory to one range for each technology and name.

Defined cases: null or malformed texts give no rows; a missing version is open at both ends; development
entries of JSON files are dropped; repeated rows merge; clashing extra columns aren't carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.versions import order_key, version_range
from tessera.operators.closure import closure, nearest_ancestor_value
from tessera.operators.r_packages import r_packages
from tessera.operators.rules import first_match
from tessera.staging import written

COLUMNS = ["path", "dir", "techno", "name", "version", "low", "high", "environment"]


def _rows(found: DataFrame, techno: str, name: Column, version: Column, environment: Column | None = None) -> DataFrame:
    v = F.nullif(F.trim(version), F.lit(""))
    range_of = version_range(v)
    own = found.select("path", "dir", F.lit(techno).alias("techno"), F.trim(name).alias("name"), v.alias("version"), range_of["low"].alias("low"), range_of["high"].alias("high"), (F.lit("prod") if environment is None else environment).alias("environment"))
    return own.where("name IS NOT NULL AND name <> ''")


def _named(files: DataFrame, *names: str) -> DataFrame:
    return files.where(F.lower("name").isin(*[n.lower() for n in names]) & F.col("text").isNotNull()).select("path", "dir", "text")


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", "dir", F.posexplode(F.split("text", r"\r?\n")).alias("place", "line"))


def requirements(files: DataFrame) -> DataFrame:
    """``name op version`` lines of requirements files that aren't for development or tests."""
    own = files.where(F.rlike("name", F.lit(r"(?i)^requirements.*\.txt$")) & ~F.rlike("name", F.lit(r"(?i)(?:dev|tests?)\.txt$")) & F.col("text").isNotNull())
    line = F.regexp_replace("line", r"(?:\s*#|\s*;|\s+--[a-z]).*$", "")
    found = _lines(own.withColumn("text", F.regexp_replace("text", r"\\\r?\n", " "))).withColumn("line", F.trim(line)).where(F.rlike("line", F.lit(r"^[A-Za-z0-9]")))
    return _rows(found, "Python", F.regexp_extract("line", r"^([A-Za-z0-9][\w.-]*)", 1), F.regexp_extract("line", r"^[A-Za-z0-9][\w.-]*(?:\[[^\]]*\])?\s*(.*)$", 1))


def _json_map(files: DataFrame, field: str) -> DataFrame:
    """(path, dir, name, version) of an object of strings in a JSON file."""
    own = F.from_json(F.get_json_object("text", f"$.{field}"), "map<string,string>")
    return files.select("path", "dir", F.explode(own).alias("key", "value"))


def npm_packages(files: DataFrame) -> DataFrame:
    """Run-time dependencies of package.json."""
    found = _json_map(_named(files, "package.json"), "dependencies")
    return _rows(found, "JS", F.col("key"), F.col("value"))


def bower(files: DataFrame) -> DataFrame:
    """Run-time dependencies of bower.json and .bower.json."""
    found = _json_map(_named(files, "bower.json", ".bower.json"), "dependencies")
    return _rows(found, "JS", F.col("key"), F.col("value"))


def nested_json(files: DataFrame, field: str) -> DataFrame:
    """(path, dir, key, value: JSON text) of the objects below ``field``, and of those below the same field of each of them, level by level."""
    each = lambda text: F.explode(F.from_json(F.get_json_object(text, f"$.{field}"), "map<string,string>"))
    level = files.select("path", "dir", each(F.col("text")).alias("key", "value"))
    every = level
    while not level.isEmpty():
        level = written(level.where(F.contains("value", F.lit(f'"{field}"'))).select("path", "dir", each(F.col("value")).alias("key", "value")), "json")
        every = every.union(level)
    return every


def npm_lock(files: DataFrame) -> DataFrame:
    """Packages of package-lock.json (all versions of the format, nested ones too), development ones dropped."""
    text = _named(files, "package-lock.json")
    old = nested_json(text, "dependencies")
    new = text.select("path", "dir", F.explode(F.from_json(F.get_json_object("text", "$.packages"), "map<string,string>")).alias("key", "value")).where("key <> ''")
    both = old.union(new.withColumn("key", F.regexp_extract("key", r"(?:^|.*node_modules/)([^/]+(?:/[^/]+)?)$", 1)))
    own = F.from_json("value", "version string, dev boolean")
    found = both.select("path", "dir", "key", own.alias("p")).where("NOT coalesce(p.dev, false)").select("path", "dir", "key", "p.version").distinct()
    return _rows(found, "JS", F.col("key"), F.col("version"))


def composer(files: DataFrame) -> DataFrame:
    """composer.json's requirements, with the version of composer.lock beside it where there is one."""
    asked = _json_map(_named(files, "composer.json"), "require").where(~F.rlike("key", F.lit(r"^(?:php$|ext-)")))
    locked = _named(files, "composer.lock").select("dir", F.explode(F.from_json(F.get_json_object("text", "$.packages"), "array<struct<name:string,version:string>>")).alias("p"))
    locked = locked.groupBy(F.col("dir").alias("l_dir"), F.col("p.name").alias("l_name")).agg(F.max("p.version").alias("locked"))
    both = asked.join(locked, F.col("dir").eqNullSafe(F.col("l_dir")) & (F.col("key") == F.col("l_name")), "left")
    return _rows(both, "PHP", F.col("key"), F.regexp_replace(F.coalesce("locked", "value"), r"^v(?=\d)", ""))


def yarn_lock(files: DataFrame) -> DataFrame:
    """Packages and versions of yarn.lock."""
    entry = r'(?m)^"?((?:@[^@"\s]+/)?[^@"\s,#]+)@[^\n]*:\s*\n\s+version:?\s+"?([^"\n]+)"?'
    text = _named(files, "yarn.lock")
    found = text.select("path", "dir", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(entry), F.lit(1)).alias("n"), F.regexp_extract_all("text", F.lit(entry), F.lit(2)).alias("v"))).alias("e"))
    return _rows(found.distinct(), "JS", F.col("e.n"), F.col("e.v"))


def _pairs(files: DataFrame, pattern: str, *more: str) -> DataFrame:
    """(path, dir, columns of ``more``, e.n, e.v) for each match of a pattern with two groups."""
    zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("v"))
    return files.select("path", "dir", *more, F.explode(zipped).alias("e"))


def _go_block(verb: str) -> Column:
    """The lines of go.mod that belong to a verb, in brackets or not, without the verb and comments."""
    text = F.concat(F.regexp_replace("text", r"//[^\n]*", ""), F.lit("\n"))
    listed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(rf"(?ms)^{verb}\s*\((.*?)^\s*\)"), F.lit(1)), lambda x: F.split(x, "\n")))
    single = F.regexp_extract_all(text, F.lit(rf"(?m)^{verb}[ \t]+([^(\n]+)$"), F.lit(1))
    return F.filter(F.transform(F.concat(listed, single), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def go_modules(files: DataFrame) -> DataFrame:
    """Modules that go.mod requires, with what replaces them; excluded versions are no dependencies, nor is what a local folder replaces."""
    own = _named(files, "go.mod")
    asked = own.select("path", "dir", F.explode(_go_block("require")).alias("line"))
    asked = asked.select("path", "dir", F.regexp_extract("line", r"^(\S+)\s+v\d", 1).alias("n"), F.regexp_extract("line", r"^\S+\s+v(\d\S*)", 1).alias("v")).where("n <> ''")
    line = own.select("path", F.explode(_go_block("replace")).alias("line"))
    other = line.select(F.col("path").alias("r_path"), F.regexp_extract("line", r"^(\S+)", 1).alias("r_n"), F.regexp_extract("line", r"=>\s*(\S+)", 1).alias("to_n"), F.nullif(F.regexp_extract("line", r"=>\s*\S+\s+v(\d\S*)", 1), F.lit("")).alias("to_v"))
    other = other.groupBy("r_path", "r_n").agg(F.min_by("to_n", F.struct("to_n", "to_v")).alias("to_n"), F.min_by("to_v", F.struct("to_n", "to_v")).alias("to_v"))
    both = asked.join(other, (F.col("path") == F.col("r_path")) & (F.col("n") == F.col("r_n")), "left")
    both = both.where(~F.rlike(F.coalesce("to_n", F.lit("")), F.lit(r"^(?:\.{0,2}/|[A-Za-z]:[\\/])")))
    return _rows(both, "Go", F.coalesce("to_n", "n"), F.when(F.col("to_n").isNull(), F.col("v")).otherwise(F.col("to_v")))


def go_sums(files: DataFrame) -> DataFrame:
    """go.sum with the greatest version of each module, compared part by part from the left."""
    found = _pairs(_named(files, "go.sum"), r"(?m)^(\S+)\s+v(\d[^\s/]*)")
    number = F.regexp_extract("e.v", r"^([\d.]+)", 1)
    best = found.groupBy("path", "dir", F.col("e.n").alias("n")).agg(F.max_by("e.v", F.struct(order_key(number), F.col("e.v"))).alias("v"))
    return _rows(best, "Go", F.col("n"), F.col("v"))


def gem_lock(files: DataFrame) -> DataFrame:
    """Gems at the first level of Gemfile.lock's specs."""
    found = _pairs(_named(files, "Gemfile.lock"), r"(?m)^ {4}([\w.\-]+) \(([^)]+)\)")
    return _rows(found, "Ruby", F.col("e.n"), F.col("e.v"))


def poetry_lock(files: DataFrame) -> DataFrame:
    found = _pairs(_named(files, "poetry.lock"), r'(?m)^\[\[package\]\]\s*\nname\s*=\s*"([^"]+)"\s*\nversion\s*=\s*"([^"]+)"')
    return _rows(found, "Python", F.col("e.n"), F.col("e.v"))


def pyproject(files: DataFrame) -> DataFrame:
    """Poetry's dependency tables and the project's dependency lists of pyproject.toml; groups and optional ones have their group as environment."""
    text = _named(files, "pyproject.toml")
    table = text.withColumn("text", F.regexp_extract("text", r"(?s)\[tool\.poetry\.dependencies\]\s*\n(.*?)(?:\n\[|\z)", 1))
    first = _pairs(table, r'(?m)^([\w.\-]+)\s*=\s*(?:\{[^}\n]*version\s*=\s*)?"([^"\n]*)"').where("e.n <> 'python'")
    listed = text.withColumn("text", F.regexp_extract("text", r"(?s)\[project\].*?\ndependencies\s*=\s*\[(.*?)\n?\s*\]\s*(?:\n|\z)", 1))
    second = _pairs(listed, r"[\"']([A-Za-z0-9][\w.\-]*)(?:\[[^\]]*\])?\s*([^\"';]*)")
    plain = _rows(first.union(second), "Python", F.col("e.n"), F.col("e.v"))
    each = text.select("path", "dir", F.explode(F.split("text", r"(?m)^(?=\[)")).alias("text"))
    group = F.regexp_extract("text", r"^\[tool\.poetry\.(?:group\.([\w\-]+)\.dependencies|dev-dependencies)\]", 1)
    tables = each.where(F.rlike("text", F.lit(r"^\[tool\.poetry\.(?:group\.[\w\-]+\.|dev-)dependencies\]"))).withColumn("group", F.coalesce(F.nullif(group, F.lit("")), F.lit("dev")))
    third = _pairs(tables, r'(?m)^([\w.\-]+)\s*=\s*(?:\{[^}\n]*version\s*=\s*)?"([^"\n]*)"', "group").where("e.n <> 'python'")
    lists = _pairs(each.where(F.rlike("text", F.lit(r"^\[(?:project\.optional-dependencies|dependency-groups)\]"))), r"(?ms)^([\w\-]+)\s*=\s*\[((?:[^\[\]]|\[[^\[\]]*\])*)\]")
    fourth = _pairs(lists.select("path", "dir", F.col("e.n").alias("group"), F.col("e.v").alias("text")), r"[\"']([A-Za-z0-9][\w.\-]*)(?:\[[^\]]*\])?\s*([^\"';]*)", "group")
    return plain.union(_rows(third.union(fourth), "Python", F.col("e.n"), F.col("e.v"), F.col("group")))


def setup_py(files: DataFrame) -> DataFrame:
    """The literal install_requires list of setup.py."""
    text = _named(files, "setup.py").withColumn("text", F.regexp_extract("text", r"(?s)install_requires\s*=\s*\[(.*?)\]", 1))
    return _rows(_pairs(text, r"[\"']([A-Za-z0-9][\w.\-]*)\s*([^\"';]*)"), "Python", F.col("e.n"), F.col("e.v"))


_GRADLE = r"(api|implementation|compile|compileOnly|runtime|runtimeOnly|provided|testImplementation|testCompile)"


def gradle(files: DataFrame) -> DataFrame:
    """Dependencies of build.gradle and build.gradle.kts: ``group:name:version`` strings, the form with ``group:``, ``name:`` and ``version:``, entries of lists and platforms; variables of the same file are filled in, and aliases of version catalogs."""
    own = files.where(F.rlike("name", F.lit(r"(?i)^build\.gradle(?:\.kts)?$")) & F.col("text").isNotNull()).select("path", "dir", "text")

    def zipped(pattern: str, **groups: int) -> Column:
        return F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(i)).alias(k) for k, i in groups.items()])

    variables = zipped(r"(?m)^\s*(?:def|val|var|ext\.)?\s*(\w+)\s*=\s*[\"']([\w.\-]+)[\"']", n=1, v=2)
    entries = zipped(r"(\w+)\s*:\s*[\"']([\w.\-]+:[\w.\-]+(?::[^\"'@:]+)?)[\"']", n=1, v=2)
    plain = zipped(rf"(?m)^\s*{_GRADLE}[\s(]+(?:(?:enforcedP|p)latform\s*\(\s*)?[\"']([\w.\-]+:[\w.\-]+)(?::([^\"'@:]+))?[^\"']*[\"']", c=1, n=2, v=3)
    mapped = zipped(rf"(?m)^\s*{_GRADLE}[\s(]+group\s*[:=]\s*[\"']([\w.\-]+)[\"']\s*,\s*name\s*[:=]\s*[\"']([\w.\-]+)[\"'](?:\s*,\s*version\s*[:=]\s*[\"']?([^\"',)\n]+)[\"']?)?", c=1, g=2, a=3, v=4)
    listed = zipped(rf"(?m)^\s*{_GRADLE}[\s(]+\w+\.(\w+)\s*\)?\s*$", c=1, k=2)
    of_list = lambda k: F.try_element_at(F.filter("entries", lambda e: e["n"] == k), F.lit(1))["v"]
    one = lambda c, n, v: F.struct(c.alias("c"), n.alias("n"), v.alias("v"))
    every = F.concat(
        F.transform("plain", lambda e: one(e["c"], e["n"], e["v"])),
        F.transform("mapped", lambda e: one(e["c"], F.concat(e["g"], F.lit(":"), e["a"]), F.trim(e["v"]))),
        F.transform("listed", lambda e: one(e["c"], F.substring_index(of_list(e["k"]), ":", 2), F.regexp_extract(of_list(e["k"]), r"^[^:]*:[^:]*:(.*)$", 1))),
    )
    found = own.select("path", "dir", variables.alias("vars"), entries.alias("entries"), plain.alias("plain"), mapped.alias("mapped"), listed.alias("listed"))
    found = found.select("path", "dir", "vars", F.explode(F.filter(every, lambda e: e["n"].isNotNull())).alias("e"))
    named = F.regexp_extract("e.v", r"^\$?\{?(\w+)\}?$", 1)
    value = F.try_element_at(F.filter("vars", lambda x: x["n"] == named), F.lit(1))["v"]
    version = F.when(F.startswith("e.v", F.lit("$")), value).otherwise(F.coalesce(F.when(named != "", value), F.col("e.v")))
    environment = lambda c: F.when(F.startswith(c, F.lit("test")), "test").otherwise("prod")
    named_in_catalogs = _pairs(own, rf"(?m)^\s*{_GRADLE}[\s(]+(?:(?:enforcedP|p)latform\s*\(\s*)?libs\.([\w.]+)").select("path", "dir", F.col("e.n").alias("c"), F.col("e.v").alias("alias"))
    above = _dirs_above(named_in_catalogs.select("dir").distinct()).join(gradle_catalogs(files), F.col("at") == F.col("c_dir"))
    nearest = above.groupBy("dir", "alias").agg(F.max_by(F.struct("n", "v"), "depth").alias("x"))
    of_catalogs = named_in_catalogs.join(nearest, ["dir", "alias"])
    return _rows(found, "Java", F.col("e.n"), version, environment("e.c")).union(_rows(of_catalogs, "Java", F.col("x.n"), F.col("x.v"), environment("c")))


def _dirs_above(dirs: DataFrame) -> DataFrame:
    """(dir, depth, at): each directory with itself and those above it."""
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return dirs.select("*", F.posexplode(above).alias("depth", "at"))


def gradle_catalogs(files: DataFrame) -> DataFrame:
    """(c_dir: the directory that a version catalog is for, alias: with dots, n: group and name, v)."""
    own = _named(files, "libs.versions.toml").select(F.regexp_replace("dir", r"(?:^|/)gradle$", "").alias("c_dir"), F.concat(F.regexp_replace("text", r"(?m)^\s*#.*$", ""), F.lit("\n[")).alias("text"))
    section = lambda name: F.regexp_extract("text", rf"(?s)\[{name}\](.*?)\n\[", 1)
    every = lambda text, pattern: F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v"))
    versions = F.map_from_entries(F.array_distinct(every(section("versions"), r'(?m)^\s*([\w\-.]+)\s*=\s*"([^"]+)"')))
    entry = F.explode(every(section("libraries"), r"(?m)^\s*([\w\-.]+)\s*=\s*(\{[^}]*\}|\"[^\"]*\")")).alias("e")
    each = own.select("c_dir", versions.alias("versions"), entry)
    field = lambda name: F.nullif(F.regexp_extract("e.v", rf'\b{name}\s*=\s*"([^"]*)"', 1), F.lit(""))
    whole = F.regexp_extract("e.v", r'^"([^"]*)"$', 1)
    name = F.coalesce(field("module"), F.concat_ws(":", field("group"), field("name")))
    version = F.coalesce(F.try_element_at("versions", field(r"version\.ref")), field("version"))
    plain = whole != ""
    return each.select("c_dir", F.regexp_replace("e.k", r"[\-_]", ".").alias("alias"), F.when(plain, F.substring_index(whole, ":", 2)).otherwise(name).alias("n"), F.when(plain, F.regexp_extract(whole, r"^[^:]*:[^:]*:(.*)$", 1)).otherwise(version).alias("v"))


#: Options and schemas of the XML readers: names without their namespaces; a text that is no XML gives nulls.
_XML = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
_REFERENCE = "array<struct<_Include: string, _Version: string, Version: string>>"
_ITEMS = f"array<struct<PackageReference: {_REFERENCE}>>"
CSPROJ = f"PackageReference {_REFERENCE}, ItemGroup {_ITEMS}, Choose array<struct<When: array<struct<ItemGroup: {_ITEMS}>>, Otherwise: array<struct<ItemGroup: {_ITEMS}>>>>"
BOM = "dependencies struct<dependency: array<struct<_ref: string, dependency: array<struct<_ref: string>>>>>"
_DEPENDENCIES = "struct<dependency: array<struct<groupId: string, artifactId: string, version: string, scope: string>>>"
POM = (
    "groupId string, artifactId string, version string, parent struct<groupId: string, artifactId: string, version: string>, properties map<string, string>,"
    f" dependencies {_DEPENDENCIES}, dependencyManagement struct<dependencies: {_DEPENDENCIES}>,"
    f" profiles struct<profile: array<struct<dependencies: {_DEPENDENCIES}, dependencyManagement: struct<dependencies: {_DEPENDENCIES}>>>>"
)


def xml_of(text: Column, schema: str) -> Column:
    """The document below a text's root element as a struct; an ampersand that begins no entity is one."""
    return F.from_xml(F.regexp_replace(text, r"&(?!#?\w+;)", "&amp;"), F.lit(schema), _XML)


def csproj(files: DataFrame) -> DataFrame:
    """Package references of .csproj and .vbproj files, with the version as an attribute or as an element."""
    own = files.where(F.rlike("name", F.lit(r"(?i)\.(?:cs|vb)proj$")) & F.col("text").isNotNull()).select("path", "dir", xml_of(F.col("text"), CSPROJ).alias("x"))
    of = lambda groups: F.flatten(F.transform(groups, lambda g: F.coalesce(g["PackageReference"], F.array().cast(_REFERENCE))))
    chosen = F.flatten(F.transform("x.Choose", lambda c: F.concat(*[F.flatten(F.transform(F.coalesce(c[k], F.array().cast(f"array<struct<ItemGroup: {_ITEMS}>>")), lambda w: F.coalesce(of(w["ItemGroup"]), F.array().cast(_REFERENCE)))) for k in ("When", "Otherwise")])))
    refs = F.concat(*[F.coalesce(a, F.array().cast(_REFERENCE)) for a in (F.col("x.PackageReference"), of("x.ItemGroup"), chosen)])
    found = own.select("path", "dir", F.explode(refs).alias("r"))
    return _rows(found, "CS", F.col("r._Include"), F.coalesce(F.nullif("r._Version", F.lit("")), "r.Version"))


def ant_jars(files: DataFrame) -> DataFrame:
    """Libraries that a build.xml names by file."""
    bare = _named(files, "build.xml").withColumn("text", F.regexp_replace("text", r"(?s)<!--.*?-->", ""))
    found = _pairs(bare, r"[\"'/\\]([A-Za-z][\w.]*?(?:-[A-Za-z][\w.]*)*)-(\d[\w.\-]*)\.jar\b")
    return _rows(found.distinct(), "Java", F.col("e.n"), F.col("e.v"))


def r_libraries(files: DataFrame) -> DataFrame:
    """Packages that R scripts load or install, those that variables hold too."""
    own = files.where(F.rlike("name", F.lit(r"(?i)\.r$")) & F.col("text").isNotNull()).select("path", "dir", "text")
    found = r_packages(own.select("path", "text")).withColumnRenamed("path", "of")
    return _rows(own.select("path", "dir").distinct().join(found, F.col("path") == F.col("of")), "R", F.col("package"), F.lit(None).cast("string"))


def cyclonedx(files: DataFrame) -> DataFrame:
    """``ref`` attributes of the dependency elements of CycloneDX files, cut into group, artifact and version."""
    own = files.where(F.rlike("text", F.lit(r"<(?:\w+:)?bom\b"))).select("path", "dir", xml_of(F.col("text"), BOM)["dependencies"]["dependency"].alias("d"))
    refs = F.flatten(F.transform("d", lambda d: F.concat(F.array(d["_ref"]), F.coalesce(F.transform(d["dependency"], lambda x: x["_ref"]), F.array().cast("array<string>")))))
    found = own.select("path", "dir", F.explode(refs).alias("ref")).where("ref IS NOT NULL")
    group, rest = F.substring_index("ref", ":", 1), F.expr("substring(ref, instr(ref, ':') + 1)")
    return found.select("path", "dir", "ref", group.alias("group"), F.substring_index(rest, "@", 1).alias("artifact"), F.when(F.contains(rest, F.lit("@")), F.substring_index(rest, "@", -1)).alias("version"))


# Maven: projects, parents, properties, dependencies.


def maven_projects(files: DataFrame) -> DataFrame:
    """(path, dir, x: the document, group, artifact, version, parent_group, parent_artifact, parent_version) of pom.xml files."""
    own = _named(files, "pom.xml").where(F.rlike("text", F.lit(r"<(?:\w+:)?project\b")))
    xml = own.select("path", "dir", xml_of(F.col("text"), POM).alias("x"))
    field = lambda name: F.nullif(F.trim(F.col(f"x.{name}")), F.lit(""))
    parent_group, parent_version = field("parent.groupId"), field("parent.version")
    return xml.select(
        "path", "dir", "x", F.coalesce(field("groupId"), parent_group).alias("group"), field("artifactId").alias("artifact"), F.coalesce(field("version"), parent_version).alias("version"),
        parent_group.alias("parent_group"), field("parent.artifactId").alias("parent_artifact"), parent_version.alias("parent_version"),
    )


def maven_parents(projects: DataFrame) -> DataFrame:
    """(node, parent): paths of projects and of their parents among the files, by group, artifact and, where given, version."""
    up = projects.select(F.col("path").alias("parent"), F.col("group").alias("g"), F.col("artifact").alias("a"), F.col("version").alias("v"))
    same = (F.col("parent_group") == F.col("g")) & (F.col("parent_artifact") == F.col("a")) & (F.col("parent_version").isNull() | F.col("v").isNull() | (F.col("parent_version") == F.col("v")))
    return projects.join(up, same).where("path <> parent").groupBy(F.col("path").alias("node")).agg(F.min("parent").alias("parent"))


def maven_properties(projects: DataFrame) -> DataFrame:
    """(node, key, value) of all projects' properties, their own version and group included."""
    pairs = F.coalesce(F.map_entries("x.properties"), F.array().cast("array<struct<key:string,value:string>>"))
    own = F.array(F.struct(F.lit("project.version").alias("key"), F.col("version").alias("value")), F.struct(F.lit("project.groupId").alias("key"), F.col("group").alias("value")))
    return projects.select(F.col("path").alias("node"), F.inline(F.concat(pairs, own))).where("value IS NOT NULL").select("node", "key", F.trim("value").alias("value"))


def maven_declared(projects: DataFrame) -> DataFrame:
    """(path, dir, managed, group, artifact, version, scope): dependency elements as they are written, those of profiles too."""
    none = F.array().cast("array<struct<groupId: string, artifactId: string, version: string, scope: string>>")
    of_profiles = lambda of: F.flatten(F.transform("x.profiles.profile", lambda p: F.coalesce(of(p), none)))
    managed = F.concat(F.coalesce("x.dependencyManagement.dependencies.dependency", none), F.coalesce(of_profiles(lambda p: p["dependencyManagement"]["dependencies"]["dependency"]), none))
    plain = F.concat(F.coalesce("x.dependencies.dependency", none), F.coalesce(of_profiles(lambda p: p["dependencies"]["dependency"]), none))
    each = lambda own, flag: F.transform(own, lambda d: F.struct(F.lit(flag).alias("managed"), d.alias("x")))
    both = projects.select("path", "dir", F.explode(F.concat(each(managed, True), each(plain, False))).alias("d"))
    field = lambda tag: F.nullif(F.trim(F.col(f"d.x.{tag}")), F.lit(""))
    return both.select("path", "dir", "d.managed", field("groupId").alias("group"), field("artifactId").alias("artifact"), field("version").alias("version"), field("scope").alias("scope"))


def maven(files: DataFrame) -> DataFrame:
    """Dependencies of pom.xml files: versions come from the element, else from the nearest ancestor's managed one; properties are those of the nearest ancestor that has them."""
    projects = maven_projects(files)
    parents, declared = maven_parents(projects), maven_declared(projects)
    key = F.concat_ws(":", "group", "artifact")
    managed = declared.where("managed AND version IS NOT NULL").select(F.col("path").alias("node"), key.alias("key"), F.col("version").alias("value"))
    plain = declared.where("NOT managed").withColumn("key", key)
    open_versions = plain.where("version IS NULL").select(F.col("path").alias("node"), "key").distinct()
    given = nearest_ancestor_value(open_versions, parents, managed).select(F.col("node").alias("m_node"), F.col("key").alias("m_key"), F.col("value").alias("managed_version"))
    filled = plain.join(given, (F.col("path") == F.col("m_node")) & (F.col("key") == F.col("m_key")), "left").withColumn("version", F.coalesce("version", "managed_version"))
    nodes = projects.select(F.col("path").alias("node"))
    lines = closure(parents.select(F.col("node").alias("parent"), F.col("parent").alias("child")), nodes)
    given = maven_properties(projects).groupBy("node", "key").agg(F.min("value").alias("value"))
    nearest = lines.join(given, "node").groupBy("root", "key").agg(F.min_by("value", "depth").alias("value"))
    values = nearest.groupBy(F.col("root").alias("p_node")).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("props"))  # one project's and its ancestors'
    known = filled.join(values, F.col("path") == F.col("p_node"), "left")
    return _rows(known, "Java", F.concat_ws(":", "group", "artifact"), interpolated(F.col("version"), F.col("props")), F.coalesce("scope", F.lit("prod")))


def interpolated(text: Column, values: Column) -> Column:
    """A text with ``${name}`` replaced by the map's values, those in the values too; names without a value go, cycles end."""

    def step(t: Column, _: Column) -> Column:
        name = F.regexp_extract(t, r"\$\{([^}]*)\}", 1)
        return F.when(name != "", F.replace(t, F.concat(F.lit("${"), name, F.lit("}")), F.coalesce(F.try_element_at(values, name), F.lit("")))).otherwise(t)

    rounds = F.size(F.coalesce(F.map_keys(values), F.array().cast("array<string>"))) + F.regexp_count(text, F.lit(r"\$\{"))
    whole = F.aggregate(F.sequence(F.lit(0), rounds), text, step)
    return F.when(F.contains(text, F.lit("${")), F.when(F.contains(whole, F.lit("${")), F.lit(None)).otherwise(whole)).otherwise(text)


#: Readers with the names of the files that they read, the family of their precedence and their rank in it (least wins).
READERS = [
    (poetry_lock, r"poetry\.lock", "Python", 0),
    (pyproject, r"pyproject\.toml", "Python", 1),
    (requirements, r"requirements(?!.*(?:dev|tests?)\.txt$).*\.txt", "Python", 1),
    (setup_py, r"setup\.py", "Python", 1),
    (npm_lock, r"package-lock\.json", "JS", 0),
    (npm_packages, r"package\.json", "JS", 1),
    (bower, r"\.?bower\.json", "JS", 2),
    (go_sums, r"go\.sum", "Go", 0),
    (go_modules, r"go\.mod", "Go", 1),
    (composer, r"composer\.(?:json|lock)", "PHP", 0),
    (gem_lock, r"Gemfile\.lock", "Ruby", 0),
    (gradle, r"build\.gradle(?:\.kts)?", "Java", 0),
    (maven, r"pom\.xml", "Java", 0),
    (csproj, r".*\.(?:cs|vb)proj", "CS", 0),
    (ant_jars, r"build\.xml", "Java", 0),
    (r_libraries, r".*\.r", "R", 0),
]
#: Files that no reader of the inventory reads for itself.
BESIDE = r"yarn\.lock|libs\.versions\.toml"


def manifest_files(files: DataFrame) -> DataFrame:
    """The files that a reader of the inventory may read, by name, as a small table of their own: (path, dir, name, text)."""
    names = "|".join([p for _, p, _, _ in READERS] + [BESIDE])
    return written(files.select("path", "dir", "name", "text").where(F.rlike("name", F.lit(rf"(?i)^(?:{names})$"))), "manifests")


def inventory(files: DataFrame) -> DataFrame:
    """Dependencies of all manifests, JS ones with yarn's versions.

    In each directory, a technology's lock file excludes its looser manifests, whatever it holds.
    """
    own = manifest_files(files)
    every = None
    for reader, name, family, rank in READERS:
        one = reader(own).select(*COLUMNS, F.lit(family).alias("family"), F.lit(rank).alias("rank"))
        every = one if every is None else every.union(one)
    ranked = F.array(*[F.when(F.rlike("name", F.lit(rf"(?i)^(?:{name})$")), F.struct(F.lit(family).alias("f"), F.lit(rank).alias("r"))) for _, name, family, rank in READERS])
    ranks = own.where("text IS NOT NULL").select("dir", F.explode(F.filter(ranked, lambda x: x.isNotNull())).alias("x"))
    least = ranks.groupBy(F.col("dir").alias("l_dir"), F.col("x.f").alias("l_family")).agg(F.min("x.r").alias("least"))
    kept = every.join(least, F.col("dir").eqNullSafe(F.col("l_dir")) & (F.col("family") == F.col("l_family"))).where("rank = least")
    return with_yarn_versions(kept.select(*COLUMNS), own)


def by_selectors(found: DataFrame, rules: DataFrame, as_column: str = "rule") -> DataFrame:
    """Dependencies with the name of the first rule (ordinal, name, pattern) whose selector fits their whole name; null if none does."""
    anchored = rules.select("ordinal", "name", F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")$")).alias("pattern"))
    return first_match(found, anchored, "name", as_column)


def with_yarn_versions(found: DataFrame, files: DataFrame) -> DataFrame:
    """JS dependencies with the version of the yarn.lock that has their name in their directory, or in the nearest one above."""
    locked = yarn_lock(files).groupBy(F.col("dir").alias("y_dir"), F.lower("name").alias("y_name")).agg(F.max("version").alias("y_version"))
    asked = _dirs_above(found.where("techno = 'JS'").select("dir", F.lower("name").alias("key")).distinct())
    nearest = asked.join(locked, (F.col("at") == F.col("y_dir")) & (F.col("key") == F.col("y_name"))).groupBy(F.col("dir").alias("n_dir"), F.col("key").alias("n_name")).agg(F.max_by("y_version", "depth").alias("y_version"))
    both = found.join(nearest, (F.col("dir") == F.col("n_dir")) & (F.lower("name") == F.col("n_name")) & (F.col("techno") == "JS"), "left")
    version = F.coalesce("y_version", "version")
    return both.select(*[F.when(F.col("y_version").isNotNull(), F.col("y_version")).otherwise(F.col(c)).alias(c) if c in ("low", "high") else version.alias(c) if c == "version" else F.col(c) for c in COLUMNS])


def merged(found: DataFrame) -> DataFrame:
    """A row for each (techno, lower-case name): name, low, high, conflict, environments, files.

    The range is what all rows allow: the greatest least version and the least greatest one; ``conflict`` if
    none is left. Versions that can't be compared don't narrow. Aggregated before the shuffle, so hot names
    cost a row from each task.
    """
    low_key, high_key = order_key(F.col("low")), order_key(F.col("high"))
    one = found.groupBy("techno", F.lower("name").alias("key")).agg(
        F.min("name").alias("name"),
        F.max_by("low", low_key).alias("low"),
        F.min_by("high", high_key).alias("high"),
        F.max(low_key).alias("low_key"),
        F.min(high_key).alias("high_key"),
        F.array_join(F.array_sort(F.collect_set("environment")), ",").alias("environments"),
        F.count("*").alias("files"),
    )
    return one.select("techno", "name", "low", "high", F.coalesce(F.col("low_key") > F.col("high_key"), F.lit(False)).alias("conflict"), "environments", "files")
