r"""Cloud-readiness rules: counts of imports and calls per file, application lists, and a match log.

Rules are made from lists of names: an import rule from a namespace, a call rule from a dotted name. All
rules of a technology become columns of one projection over the code view, so a file is read once. The match
log explodes lines once and joins nothing.

Defined cases: null texts count nothing; comments and strings never count for imports and calls; an unknown
technology has the literal findings only; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.lexers import LEXERS, lexical_views
from tessera.functions.literals import finding_counts
from tessera.functions.text import count_of
from tessera.functions.views import FAMILY_OF, bare_view, code_view, string_literals

#: Fixed values: .Net namespaces that count as they stand, and with all below them.
DOTNET_EXACT = "System.IO System System.Configuration Microsoft.Win32 Microsoft.WindowsAzure.Storage.Table StackExchange.Redis System.Diagnostics Microsoft.WindowsAzure.Jobs Microsoft.ServiceBus.Messaging System.Security.AccessControl".split()
DOTNET_BELOW = "Microsoft.Azure.KeyVault System.Messaging RabbitMQ.Client TIBCO.EMS IBM.WMQ System.Security.Cryptography".split()
DOTNET_BELOW_NAMED = "Microsoft.Azure.Documents Microsoft.Azure.Management.Batch System.Data.SqlClient System.ServiceProcess Amazon.S3.Model Amazon.SQS Amazon.DynamoDBv2 Amazon.SimpleDB Amazon.RDS Amazon.Redshift Amazon.KeyManagementService Amazon.ElastiCache Amazon.CloudDirectory Amazon.DirectoryService Amazon.Batch".split()
DOTNET_NAMES = "File.Move File.Create File.Delete File.Copy File.Exists File.Encrypt File.Decrypt Directory.CreateDirectory Directory.Move Directory.Delete Directory.Exists ConfigurationManager.AppSettings ConfigurationManager.ConnectionStrings".split()
DOTNET_CALLS = "Registry.GetValue Registry.SetValue Trace.WriteLine Trace.TraceError Trace.TraceInformation Trace.TraceWarning File.GetAccessControl File.SetAccessControl".split()
DOTNET_OWN = {
    "Open": r"\bFile\.Open\b",
    "GetTempPath": r"\bPath\.GetTempPath\b",
    "Log4Net": r"\blog4net\b",
    "New_Process": r"\b[Nn]ew\s+Process\s*\(",
    "New_EventLog": r"\b[Nn]ew\s+EventLog\s*\(",
    "New_EventLogTraceListener": r"\b[Nn]ew\s+EventLogTraceListener\s*\(",
    "IntanciatingKeyVaultClient": r"\bnew\s+KeyVaultClient\b",
    "EncryptAsync": r"\bEncryptAsync\s*\(",
    "DecryptAsync": r"\bDecryptAsync\s*\(",
    "ImpersonationOption": r"\bImpersonationOption\b",
    "DllImport": r"[\[<]\s*DllImport\s*\(",
    "ComImport": r"(?m)^\s*[\[<]\s*ComImport\s*[(,\]>]",
}
#: Java packages.
JAVA_PACKAGES = "java.io.File com.microsoft.azure.keyvault com.microsoft.windowsazure.services.servicebus com.microsoft.azure.storage.table redis.clients.jedis.Jedis waffle.windows.auth com.microsoft.azure.documentdb com.microsoft.azure.batch com.microsoft.azure.management.sql com.amazonaws.services.s3.model com.amazonaws.services.sqs com.amazonaws.services.dynamodbv2 com.amazonaws.services.simpledb com.amazonaws.services.rds com.amazonaws.services.redshift com.amazonaws.services.kms com.amazonaws.services.elasticache com.amazonaws.services.cloudDirectory com.amazonaws.services.directory com.amazonaws.services.batch software.amazon.awssdk.services.batch java.nio.file.attribute org.apache.commons.io.FileUtils".split()
JAVA_OWN = {
    "Write": r"\.(?:write|writeByteArrayToFile|writeLines|writeStringToFile)\s*\(",
    "New_File": r"\bnew\s+File\s*\(",
    "New_FileInputStream": r"\bnew\s+FileInputStream\s*\(",
    "Import_JavaIo": r"\bimport\s+java\.io\.\*",
    "FileCreate": r"\.createNewFile\s*\(",
    "FileRename": r"\.renameTo\s*\(",
    "DirectoryCreate": r"\.mkdirs?\s*\(",
    "IsDirectory": r"\.isDirectory\s*\(",
    "DirectoryDelete": r"\.delete\s*\(",
    "DecryptAsync": r"\.decryptAsync\s*\(",
    "EncryptAsync": r"\.encryptAsync\s*\(",
    "Spring_SessionAttribute": r"@SessionAttributes\b",
}
#: T-SQL functions that a managed database lacks.
TSQL_NAMES = "fn_my_permissions sp_addmessage fn_get_sql fn_virtualservernodes SEMANTICKEYPHRASETABLE OPENQUERY OPENROWSET OPENDATASOURCE".split()
TSQL_OWN = {"USE_statement": r"(?im)^\s*use\s+\w", "CreateCredential": r"(?i)\bcreate\s+credential\b", "AlterDatabase": r"(?i)\balter\s+database\b"}

#: Python modules, classes and functions by mnemonic; those of the second table are called.
PYTHON_NAMES = {
    "DBMS_MySQL": ["mysql.connector", "MySQLConnection", "MySQLdb.connect"],
    "DBMS_MongoDB": ["pymongo", "MongoClient"],
    "DBMS_CosmosDB": ["pydocumentdb"],
    "DBMS_PostgreSQL": ["psycopg2", "pg8000"],
    "MicrosoftAzureKeyVault": ["azure.keyvault", "KeyVaultClient", "KeyVaultId"],
    "MicrosoftAzureBlobStorage": ["azure.storage", "BlobService"],
    "AzureDirectoryService": ["adal"],
    "AzureBatch": ["import azure.batch"],
    "AzureServiceBusMessaging": ["azure.servicebus", "ServiceBusService"],
    "LaunchSubProcess": ["os.system", "os.popen", "subprocess.call", "subprocess.run", "subprocess.Popen"],
    "DirectoryCreateDirectory": ["os.mkdir", "os.makedirs"],
    "DirectoryMove": ["os.rename", "shutil.move"],
    "DirectoryChange": ["os.chdir"],
    "DirectoryAccess": ["os.access", "os.chmod", "os.chown"],
    "DirectoryCopy": ["shutil.copytree"],
    "FileDelete": ["os.remove", "os.unlink"],
    "EnvironmentVariable": ["os.environ", "os.putenv", "os.getenv"],
    "UsingKubernetes": ["import kubernetes", "from kubernetes"],
    "UsingBigQuery": ["import bigquery", "from bigquery"],
    "UsingFireBase": ["from firebase import", "from firebase_admin import"],
    "GCPStorage": ["from google.cloud import storage"],
    "UsingCloudDataflow": ["import apache_beam"],
}
PYTHON_CALLS = {"AzureCloudEncryption": ["KeyWrapper", "KeyResolver"], "Open": ["open"], "Write": ["write"]}
#: Services that a Python client is made for, by mnemonic.
PYTHON_SERVICES = {"DBMS_DynamoDB": "dynamodb", "AmazonawsS3Storage": "s3", "Import_InMemoryRedisAws": "elasticache", "AmazonawsDirectoryService": "ds", "AmazonawsBatch": "batch", "AmazonAwsAccessManagement": "iam"}

#: Modules of Node.js by mnemonic, as they are required or imported, and what stands in the code.
NODE_MODULES = {
    "New_AccessControlList": ["accesscontrol"],
    "UsingSystemSecurityCryptography": ["node-webcrypto-p11", "node-webcrypto-ossl"],
    "Path": ["path"],
    "New_FileInputStream": ["fs"],
    "MicrosoftAzureBlobStorage": ["azure-storage"],
    "DBMS_MongoDB": ["mongodb", "mongoose"],
    "DBMS_CosmosDB": ["documentdb", "documentdb-typescript"],
    "DBMS_MySQL": ["mysql"],
    "DBMS_PostgreSQL": ["pg"],
    "MicrosoftAzureKeyVault": ["azure-arm-keyvault"],
    "AwsScheduler": ["aws-scheduler"],
    "AzureScheduler": ["azure-asm-scheduler", "azure-scheduler", "azure-batch"],
    "CloudActiveDirectory": ["adal", "activedirectory", "react-adal"],
    "AzureServiceBusMessaging": ["azure-arm-sb", "azure-sb"],
    "UsingKubernetes": ["@kubernetes/client-node"],
    "UsingBigQuery": ["@google-cloud/bigquery"],
    "UsingCloudDataStore": ["@google-cloud/datastore"],
    "UsingBigTable": ["@google-cloud/bigtable"],
    "UsingCloudSpanner": ["@google-cloud/spanner"],
    "Using_InMemoryRedisGCP": ["@google-cloud/redis"],
    "UsingFireBase": ["firebase"],
    "GCPStorage": ["@google-cloud/storage"],
    "UsingCloudPubSub": ["@google-cloud/pubsub"],
}
NODE_NAMES = {
    "New_AccessControlList": ["new AccessControl"],
    "DirectoryCurrent": ["process.cwd"],
    "DirectoryChange": ["process.chdir"],
    "DirectoryExists": ["OS.File.DirectoryIterator"],
    "Path": ["OS.Path", "OS.Constants.Path"],
    "New_FileInputStream": ["FileUtils", "OS.File.read"],
    "Open": ["OS.File.open"],
    "FileCopy": ["OS.File.copy"],
    "FileMove": ["OS.File.move"],
    "EnvironmentVariable": ["process.env"],
    "New_Process": ["process.setegid", "process.seteuid", "process.setgid", "process.setgroups", "process.setuid"],
    "CodeSkipped": ["assert"],
    "AmazonawsS3Storage": ["new AWS.S3"],
    "MicrosoftAzureBlobStorage": ["createBlobService"],
    "DBMS_CosmosDB": ["new CosmosClient"],
    "AmazonawsServicesKms": ["new AWS.KMS"],
    "AwsScheduler": ["new AWS.Batch"],
    "CloudActiveDirectory": ["new AdalConfig"],
    "AzureServiceBusMessaging": ["createServiceBusService", "ServiceBusService"],
    "Using_AmazonSQS": ["new AWS.SQS"],
    "UsingCloudSpanner": ["new Spanner"],
    "Using_InMemoryRedisGCP": ["new CloudRedisClient"],
    "UsingCloudIAM": ["iam.getPolicy"],
    "UsingCloudIAP": ["class Iap"],
    "UsingCloudPubSub": ["new PubSub"],
}
NODE_OWN = {"UsingKubernetes": r"\bnew\s+\w+\.KubeConfig\b", "GCPServicesKms": r"\.cloudkms\b", "GCPScheduler": r"\bnew\s+\S*\.CloudSchedulerClient\b|\.cloudscheduler\b"}
#: Functions that C and C++ call, by mnemonic, and names that count without a call.
CPP_CALLS = {
    "DirectoryDelete": ["remove", "remove_all"],
    "DirectoryExists": ["is_directory"],
    "DirectoryCreate": ["create_directory", "create_directories"],
    "GetTempPath": ["temp_directory_path"],
    "DirectoryCurrent": ["getcwd", "current_path", "get_current_dir_name", "directory_iterator"],
    "Open": ["open", "fopen"],
    "FileExists": ["exists", "is_regular_file"],
    "FileCopy": ["copy"],
    "New_FileInputStream": ["getline", "FileInputStream"],
    "FileRead": ["read"],
    "FileDelete": ["remove"],
    "New_AccessControlList": ["SetNamedSecurityInfo", "GetExplicitEntriesFromAcl"],
}
CPP_NAMES = {"EnvironmentVariable": ["getenv", "secure_getenv"], "IdentityImpersonateTrue": ["ImpersonateLoggedOnUser"]}
CPP_OWN = {
    "New_EventLog": r"\b(?:ReportEvent|RegisterEventSource)\s*\(|\bEventLog\b",
    "HardCodedConnectionString": r"\bConnectionString\b|\bSQLDriverConnect\w*\s*\(",
    "DllImport": r"\b(?:__declspec\s*\(\s*dll(?:im|ex)port\s*\)|(?:LoadLibrary|dlopen)\s*\()",
}
#: Words of COBOL by mnemonic, whatever their case, and programs that literals name.
COBOL_WORDS = {
    "DISPLAY_statement": ["DISPLAY"],
    "ALTER_statement": ["ALTER"],
    "GOTO_statement": ["GO TO"],
    "CodeSkipped": ["SOURCE-COMPUTER IBM-370 WITH DEBUGGING MODE"],
    "DecimalPointComma": ["DECIMAL-POINT IS COMMA"],
    "CurrencySign": ["CURRENCY SIGN IS"],
    "OccurClause": ["OCCUR", "OCCURS"],
    "RedefinesClause": ["REDEFINES"],
    "DummyTable": ["SYSIBM.SYSDUMMY1"],
    "JSONParsing": ["JSON PARSE"],
    "UROption": ["WITH UR"],
    "CICSWebservice": ["EXEC CICS INVOKE WEBSERVICE"],
    "DB2Connect": ["EXEC SQL"],
}
COBOL_OWN = {
    "PackedDecimal": r"(?i)\bPACKED-DECIMAL\b|[^\w\-]COMP-3\b",
    "Binary": r"(?i)\bBINARY\b|[^\w\-]COMP(?:-[45])?(?:[^\w\-]|\z)",
    "SubsetRow": r"(?i)\bFETCH\s+FIRST\s+[0-9]+\s+ROWS\s+ONLY\b",
    "XMLParsing": r"(?i)\sXML\s+PARSE\b",
    "JSONGenerate": r"(?i)\sJSON\s+GENERATE\b",
}
COBOL_PROGRAMS = {
    "DLICalls": "CBLTDLI AIBTDLI CEETDLI PLITDLI".split(),
    "MQCall": "MQBACK MQBUFMH MQCB MQCLOSE MQCMIT MQCONN MQCONNX MQCRTMH MQCTL MQDISC MQDLTMH MQDLTMP MQGET MQINQ MQINQMP MQMHBUF MQOPEN MQPUT MQPUT1 MQSET MQSETMP MQSTAT MQSUB MQSUBRQ".split(),
}


def _any(names: list[str], behind: str = r"\b", flags: str = "") -> str:
    """A pattern for any of some names; blanks in them are any white space."""
    return rf"{flags}\b(?:{'|'.join(re.escape(n).replace(chr(92) + ' ', chr(92) + 's+') for n in names)}){behind}"


def _joined(name: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in name.split("."))


def _using(namespace: str, below: bool) -> str:
    return rf"(?m)^[ \t]*(?:using|Imports)\s+(?:\w+\s*=\s*)?{re.escape(namespace)}" + (r"\b" if below else r"\s*(?:;|$)")


def rules(techno: str) -> dict[str, str]:
    """Mnemonics and patterns of a technology."""
    if techno in ("CS", "VbDotNet"):
        out = {f"Using{_joined(n)}": _using(n, False) for n in DOTNET_EXACT}
        out |= {f"Using{_joined(n)}": _using(n, True) for n in DOTNET_BELOW}
        out |= {f"Using_{_joined(n)}": _using(n, True) for n in DOTNET_BELOW_NAMED}
        out |= {_joined(n): rf"\b{re.escape(n)}\b" for n in DOTNET_NAMES}
        out |= {_joined(n): rf"\b{re.escape(n)}\s*\(" for n in DOTNET_CALLS}
        return out | DOTNET_OWN
    if techno == "Java":
        return {f"Import_{_joined(p)}": rf"\bimport\s+{re.escape(p)}\b" for p in JAVA_PACKAGES} | JAVA_OWN
    if techno == "TSql":
        return {n: rf"(?i)\b{n}\b" for n in TSQL_NAMES} | TSQL_OWN
    if techno == "Python":
        spaced = lambda n: re.escape(n).replace(r"\ ", r"\s+")
        return {m: rf"\b(?:{'|'.join(map(spaced, own))})\b" for m, own in PYTHON_NAMES.items()} | {m: rf"\b(?:{'|'.join(own)})\s*\(" for m, own in PYTHON_CALLS.items()}
    if techno in ("JS", "TypeScript"):
        return {m: _any(own) for m, own in NODE_NAMES.items()} | NODE_OWN
    if techno in ("C", "CCpp", "Cpp"):
        return {m: _any(own, r"\s*\(") for m, own in CPP_CALLS.items()} | {m: _any(own) for m, own in CPP_NAMES.items()} | CPP_OWN
    if techno == "Cobol":
        return {m: _any(own, flags="(?i)") for m, own in COBOL_WORDS.items()} | COBOL_OWN
    return {}


def text_rules(techno: str) -> dict[str, str]:
    """Mnemonics and patterns that need string literals as they are: modules that are loaded, programs, services named on the line that makes a client."""
    if techno in ("JS", "TypeScript"):
        return {m: rf"\b(?:require\s*\(|from|import)\s*[\"'](?:[^\"'\n]*[\\/])?(?:{'|'.join(map(re.escape, own))})(?:[\\/][^\"'\n]*)?[\"']" for m, own in NODE_MODULES.items()}
    if techno in ("C", "CCpp", "Cpp"):
        return {"SQLDatabaseUnsecureAuthentication": r"\"[^\"\n]*\b(?:Trusted_Connection|Integrated\s+Security)\b[^\"\n]*\""}
    if techno == "Cobol":
        return {m: _any(own, flags="(?i)[\"'][^\"'\n]*") for m, own in COBOL_PROGRAMS.items()}
    return {m: rf"(?i)\bboto3\.(?:client|resource)\s*\([^)\n]*[\"']{n}[\"']" for m, n in PYTHON_SERVICES.items()} if techno == "Python" else {}


def file_detections(files: DataFrame, techno: str, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and a count for each mnemonic of the technology and each kind of literal finding."""
    family = FAMILY_OF.get(techno, "none")
    if techno in LEXERS:
        views = files.select(*keys, lexical_views(F.col(text), techno).alias("__views"))
        cut = views.select(*keys, F.col("__views.code").alias("__code"), F.col("__views.strings").alias("__strings"), F.col("__views.bare").alias("__bare"))
    else:
        cut = files.select(*keys, code_view(F.col(text), family).alias("__code"), string_literals(F.col(text), family).alias("__strings"), bare_view(F.col(text), family).alias("__bare"))
    in_code, in_text = rules(techno), text_rules(techno)
    both = lambda m: [count_of(F.col(v), own[m]) for v, own in (("__code", in_code), ("__bare", in_text)) if m in own]
    own = [reduce(lambda a, b: a + b, both(m)).alias(m) for m in dict.fromkeys([*in_code, *in_text])]
    return cut.select(*keys, *own, *[c.alias(m) for m, c in finding_counts(F.col("__strings")).items()])


def application_detections(counts: DataFrame, key: str) -> DataFrame:
    """(mnemonic, files, matches) over a wide table of counts; mnemonics nobody has count zero."""
    names = [c for c in counts.columns if c != key]
    one = counts.agg(*[F.struct(F.count_if(F.col(f"`{n}`") > 0).alias("files"), F.coalesce(F.sum(f"`{n}`"), F.lit(0)).cast("bigint").alias("matches")).alias(n) for n in names])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("mnemonic"), F.col(f"`{n}`.files").alias("files"), F.col(f"`{n}`.matches").alias("matches")) for n in names])))


def match_log(files: DataFrame, techno: str, key: str, text: str = "text") -> DataFrame:
    """(alert, key, positions): for each rule and file the lines it is found in, as ``line[1,5]``; sorted by alert and key."""
    code = code_view(F.col(text), FAMILY_OF.get(techno, "none"))
    numbered = files.select(key, F.filter(F.transform(F.split(code, "\n", -1), lambda x, i: F.struct((i + 1).alias("n"), x.alias("x"))), lambda l: F.trim(l["x"]) != "").alias("lines"))
    table = F.array(*[F.struct(F.lit(m).alias("alert"), F.lit(p).alias("p")) for m, p in rules(techno).items()]).cast("array<struct<alert:string,p:string>>")
    hits = F.transform(table, lambda r: F.struct(r["alert"].alias("alert"), F.transform(F.filter("lines", lambda l: F.rlike(l["x"], r["p"])), lambda l: l["n"]).alias("at")))
    found = numbered.select(key, F.explode(F.filter(hits, lambda h: F.size(h["at"]) > 0)).alias("h"))
    return found.select("h.alert", key, F.concat(F.lit("line["), F.array_join(F.transform("h.at", lambda n: n.cast("string")), ","), F.lit("]")).alias("positions")).orderBy("alert", key)
