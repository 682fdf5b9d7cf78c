"""Cloud rules over sources that are made of the customers' numbers; the SQL adds up what each chosen piece holds, and has no patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.literals import FINDINGS
from tessera.operators import cloud as Cloud
from tessera.staging import dealt

#: Pieces of sources with what they hold; {n} stands for a number.
PIECES = {
    "JS": [
        ("const a{n} = require('fs'); // require('path')\n", {"New_FileInputStream": 1}),
        ("import { x } from \"../lib/path/deep{n}\";\n", {"Path": 1}),
        ("import 'mongoose'; import m from \"mongodb\"; import n from 'mongodbx';\n", {"DBMS_MongoDB": 2}),
        ("process.chdir(process.cwd() + process.env.HOME{n});\n", {"DirectoryChange": 1, "DirectoryCurrent": 1, "EnvironmentVariable": 1}),
        ("const s = new AWS.S3({}); const t = `new AWS.S3 ${'new AWS.SQS'}`;\n", {"AmazonawsS3Storage": 1}),
        ("const { PubSub } = require('@google-cloud/pubsub'); new PubSub(); /* new PubSub */\n", {"UsingCloudPubSub": 2}),
        ("const k = new k8s{n}.KubeConfig(); require(\"@kubernetes/client-node\");\n", {"UsingKubernetes": 2}),
        ("new ServiceBusService(x); assert(y{n}); OS.File.open(z); OS.Constants.Path;\n", {"AzureServiceBusMessaging": 1, "CodeSkipped": 1, "Open": 1, "Path": 1}),
        ("processed.env; reprocess.cwd; x = 'process.env';\n", {}),
    ],
    "CCpp": [
        ("char *p{n} = getenv(\"A\"); secure_getenv (b);\n", {"EnvironmentVariable": 2}),
        ("fs::create_directories(d{n}); remove_all(e); remove (f);\n", {"DirectoryCreate": 1, "DirectoryDelete": 2, "FileDelete": 1}),
        ("f = fopen(\"x\", m); open(y); reopen(z); // open(n)\n", {"Open": 2}),
        ("s = \"Server={n};Trusted_Connection=yes\"; t = \"Integrated  Security=1\";\n", {"SQLDatabaseUnsecureAuthentication": 2}),
        ("__declspec(dllexport) void g{n}(); h = LoadLibrary(\"LoadLibrary(\");\n", {"DllImport": 2}),
        ("EventLog l; ReportEvent(l, {n}); SQLDriverConnectW(c);\n", {"New_EventLog": 2, "HardCodedConnectionString": 1}),
        ("getline(in, s{n}); read(fd); bread(x); copy(a, b); exists(c);\n", {"New_FileInputStream": 1, "FileRead": 1, "FileCopy": 1, "FileExists": 1}),
    ],
    "Cobol": [
        ("           DISPLAY 'GO TO {n}'.\n", {"DISPLAY_statement": 1}),
        ("           go to P-{n}. GO  TO Q.\n", {"GOTO_statement": 2}),
        ("       01 A PIC 9({n}) COMP-3. 01 B BINARY. 01 C COMP.\n", {"PackedDecimal": 1, "Binary": 2}),
        ("      * DISPLAY {n} ALTER\n", {}),
        ("           EXEC SQL SELECT {n} FROM SYSIBM.SYSDUMMY1 WITH UR END-EXEC.\n", {"DB2Connect": 1, "DummyTable": 1, "UROption": 1}),
        ("           CALL 'CBLTDLI' USING X. CALL \"MQPUT1\" USING Y{n}.\n", {"DLICalls": 1, "MQCall": 1}),
        ("           02 T OCCURS {n} TIMES. 02 U REDEFINES T.\n", {"OccurClause": 1, "RedefinesClause": 1}),
    ],
}
_PICKS = ((1, 0), (3, 5), (7, 2), (5, 11), (11, 3))


def _place(k: int, m: int, o: int, n: int) -> str:
    return f"(c_custkey * {m} + b * {k + 1} + {o}) % {n}"


def cloud_query(techno: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = PIECES[techno]
        rows = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")).select("c_custkey", (F.floor("c_acctbal").cast("long") % 1000 + 1000).alias("b"))
        pieces = F.array(*[F.lit(x) for x, _ in own])
        picked = [F.get(pieces, F.expr(_place(k, m, o, len(own))).cast("int")) for k, (m, o) in enumerate(_PICKS)]
        text = F.replace(F.concat(F.lit("\n"), *picked), F.lit("{n}"), (F.col("c_custkey") % 1009 + 1).cast("string"))
        wide = Cloud.file_detections(rows.select("c_custkey", text.alias("text")), techno, ["c_custkey"]).drop(*FINDINGS)
        names = sorted({m for _, holds in own for m in holds})
        return wide.select("c_custkey", *names, reduce_sum([c for c in wide.columns if c != "c_custkey"]).alias("all_matches"))

    run.__doc__ = f"Cloud rules of {techno} over made sources: the counts of those that some piece holds, and of all."
    return run


def reduce_sum(names: list[str]):
    return F.aggregate(F.array(*[F.col(f"`{n}`") for n in names]), F.lit(0).cast("long"), lambda a, x: a + x)


def cloud_sql(techno: str) -> str:
    own = PIECES[techno]
    names = sorted({m for _, holds in own for m in holds})
    of = lambda values: " + ".join(f"({values})[{_place(k, m, o, len(own))} + 1]" for k, (m, o) in enumerate(_PICKS))
    counts = [f'({of([holds.get(name, 0) for _, holds in own])})::BIGINT AS "{name}"' for name in names]
    total = f"({of([sum(holds.values()) for _, holds in own])})::BIGINT AS all_matches"
    return f"SELECT c_custkey, {', '.join(counts)}, {total} FROM (SELECT c_custkey, floor(c_acctbal)::BIGINT % 1000 + 1000 AS b FROM customer)"


_QUERIES = {f"q53_{x.lower()}_cloud": (cloud_query(x), cloud_sql(x)) for x in PIECES}


def queries() -> dict:
    return {name: run for name, (run, _) in _QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _QUERIES.items()}
