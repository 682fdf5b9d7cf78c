"""Nodes, siblings and cloud rules on small sources."""

from tessera.operators import cloud as C
from tessera.operators import nodes as N

PY = '''class A(Base):
    def f(self, a, b=(1, 2), *c):
        """def not_this():"""
        if a:
            for x in b:
                while x:
                    if c: pass
        elif b:
            pass
        return 1

    # if nothing:
    def g(self): return 2

def h(a, b, c, d, e, f):
    try:
        pass
    except E:
        pass
'''
JS = '''function f(a, b) {
  if (a) { x(); }
  else {
    for (const i of b) {
      while (i) { y("{"); }
    }
  }
}
class B { m(z) { switch (z) { } } }
}
function g() {}
'''


def test_python_nodes(spark):
    files = spark.createDataFrame([("a", PY), ("b", None), ("c", "x = 1\n")], "path string, text string")
    found = N.nodes(files, "Python", "path")
    got = {r.node_id: (r.kind, r.name, r.parent_id, r.nesting, r.last_line) for r in found.collect()}
    assert got[1] == ("class", "A", None, 0, 14) and got[2] == ("function", "f", 1, 1, 12)
    assert got[4][:4] == ("if", None, 2, 2) and got[6][:4] == ("while", None, 5, 4) and got[7][:4] == ("if", None, 6, 5)
    assert got[13][:3] == ("function", "g", 1) and 3 not in got and 12 not in got
    siblings = {r.node_id: (r.previous_kind, r.next_kind) for r in N.with_siblings(found, "path").collect()}
    assert siblings[8] == ("if", None) and siblings[2] == (None, "function")
    m = N.node_metrics(found, "path", long_function=8, many_parameters=5).collect()
    assert len(m) == 1
    m = m[0]
    assert (m.n_function, m.n_class, m.n_if, m.long_functions, m.many_parameters, m.deep_nodes, m.missing_final_else, m.max_nesting) == (3, 1, 2, 1, 1, 2, 1, 5)
    assert N.nodes(files.limit(0), "Python", "path").count() == 0


def test_brace_nodes(spark):
    found = N.nodes(spark.createDataFrame([("a", JS)], "path string, text string"), "JS", "path")
    got = {r.node_id: (r.kind, r.name, r.parent_id, r.depth) for r in found.collect()}
    assert got[1] == ("function", "f", None, 0) and got[2][:3] == ("if", None, 1) and got[3][:3] == ("else", None, 1)
    assert got[4][:3] == ("for", None, 3) and got[5][:3] == ("while", None, 4) and got[9][:3] == ("class", "B", None)
    assert got[11] == ("function", "g", None, 0)


def test_repeated_files_stay_apart(spark):
    files = spark.createDataFrame([("a", "def f(): pass\n"), ("a", "def f(): pass\n")], "path string, text string")
    found = N.nodes(files, "Python", "path")
    assert found.count() == 2 and N.with_siblings(found, "path").where("previous_kind IS NOT NULL").count() == 0


CS = 'using System.IO;\nusing System;\nusing X = Amazon.S3.Model.Y;\n// using System.Diagnostics;\nclass A { void f() { File.Move("a", "c:/Users/joe/file.txt"); var s = "File.Copy"; Registry.GetValue ("x"); } }\n'


def test_cloud_rules(spark):
    files = spark.createDataFrame([("a.cs", CS), ("b.cs", None)], "path string, text string")
    wide = C.file_detections(files, "CS", ["path"])
    a, b = wide.orderBy("path").collect()
    assert (a.UsingSystemIO, a.UsingSystem, a.Using_AmazonS3Model, a.UsingSystemDiagnostics, a.FileMove, a.FileCopy, a.RegistryGetValue, a.HardCodedPath) == (1, 1, 1, 0, 1, 0, 1, 1)
    assert sum(v for k, v in b.asDict().items() if k != "path") == 0
    listed = {r.mnemonic: (r.files, r.matches) for r in C.application_detections(wide, "path").collect()}
    assert listed["FileMove"] == (1, 1) and listed["FileDelete"] == (0, 0)
    assert [tuple(r) for r in C.match_log(files, "CS", "path").collect()] == [("FileMove", "a.cs", "line[5]"), ("RegistryGetValue", "a.cs", "line[5]"), ("UsingSystem", "a.cs", "line[2]"), ("UsingSystemIO", "a.cs", "line[1]"), ("Using_AmazonS3Model", "a.cs", "line[3]")]
    assert C.file_detections(files.limit(0), "Java", ["path"]).count() == 0 and len(C.rules("Java")) > 30 and len(C.rules("TSql")) > 10
    assert set(C.file_detections(files, "nothing", ["path"]).columns) == {"path", "HardCodedIP", "HardCodedPath", "HTTPProtocol", "URINotSecuredHTTP", "URINotSecuredFTP", "SensitiveDataString"}
