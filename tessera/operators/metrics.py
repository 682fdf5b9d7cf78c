r"""File metrics from a declarative registry, compiled to one projection per language.

A row of the registry names a metric, the view it looks at, how it counts, and its pattern; a language's
profile lists the metrics it has. All metrics of a language become columns of one ``select``, so a text is
cut into views once and read once. Missing views give -1 at the sink only; inside they are null.

Kinds: ``count`` (matches of a pattern), ``lines`` (lines with a match), ``fn`` (a function of the view).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lexers as L
from tessera.functions import text as T
from tessera.functions import views as V
from tessera.functions.literals import finding_counts, is_ip
from tessera.staging import written


@dataclass(frozen=True)
class Metric:
    name: str
    view: str
    kind: str
    rule: str | Callable[[Column], Column]

    def column(self, views: dict[str, Column]) -> Column:
        own = views[self.view]
        if self.kind == "count":
            return T.count_of(own, self.rule)
        if self.kind == "lines":
            return T.lines_like(own, self.rule)
        return self.rule(own).cast("bigint")


def _words(view: str, **names: str) -> list[Metric]:
    """Metrics that count whole words."""
    return [Metric(name, view, "count", rf"\b{word}\b") for name, word in names.items()]


def _plain(view: str, **names: str) -> list[Metric]:
    return [Metric(name, view, "count", pattern) for name, pattern in names.items()]


BASIC = [
    Metric("LinesOfCode", "code", "fn", T.nonempty_lines),
    Metric("BlankLines", "text", "fn", T.blank_lines),
    Metric("CommentLines", "comment", "fn", T.nonempty_lines),
    Metric("AlphaNumCommentLines", "comment", "fn", T.alnum_lines),
    Metric("CommentBlocs", "agglo", "fn", V.comment_blocks),
]
LONG_LINES = [Metric(f"LongLines{n}", "text", "fn", lambda c, n=n: T.long_lines(c, n)) for n in (80, 100, 120, 132)]
COMMENTS = [
    Metric("SuspiciousComments", "comment", "fn", T.suspicious_lines),
    Metric("CommentedOutCode", "comment", "fn", T.commented_out_lines),
]
C_LIKE = [
    Metric("MagicNumbers", "code", "fn", T.magic_numbers),
    Metric("TernaryOperators", "code", "fn", T.ternary_operators),
    Metric("ComplexConditions", "code", "fn", T.complex_conditions),
    Metric("MissingBraces", "code", "fn", T.missing_braces),
    *_plain("code", EmptyCatches=r"\bcatch\b[^{}]*\{\s*\}", RiskyCatches=r"\bcatch\s*\(\s*(?:\.\.\.|Exception\b|Throwable\b)"),
]
FLOW = _words("code", If="if", Else="else", While="while", For="for", Switch="switch", Case="case", Default="default", Continue="continue", Return="return", Break="break")
C_CALLS = [
    *_words("code", Goto="goto", Exit="exit", Malloc="malloc", Calloc="calloc", Strdup="strdup", Free="free", Open="open", Close="close", Fopen="fopen", Fclose="fclose", Union="union", StructDefinitions="struct"),
    *_plain(
        "code",
        Include=r"(?m)^[ \t]*#[ \t]*include\b",
        Pragmas=r"(?m)^[ \t]*#[ \t]*pragma\b",
        IfPrepro=r"(?m)^[ \t]*#[ \t]*(?:if|ifdef|ifndef|elif)\b",
        MacroDefinitions=r"(?m)^[ \t]*#[ \t]*define\b",
        AsmLines=r"\b(?:asm|__asm|__asm__)\b",
        RiskyFunctionCalls=r"\b(?:gets|strcpy|strcat|sprintf|vsprintf|scanf|sscanf|realpath|getopt|getpass|strecpy|streadd|strtrns)\s*\(",
        WeakStringFunctionCalls=r"\b(?:strcpy|strcat|sprintf|vsprintf|gets)\s*\(",
        ShellLauncherFunctionCalls=r"\b(?:system|popen|execlp?|execvp?e?)\s*\(",
        StdioFunctionCalls=r"\b(?:printf|fprintf|scanf|fscanf|puts|gets|getchar|putchar)\s*\(",
        MultipleAssignments=r"(?<![=!<>])=(?!=)\s*\w+\s*=(?!=)",
        FixedSizeArrays=r"\b\w+\s+\w+\s*\[\s*\d+\s*\]",
    ),
]
CPP = [
    *_words("code", Try="try", Catch="catch", New="new", Delete="delete", ReinterpretCasts="reinterpret_cast"),
    *_plain("code", AnonymousNamespaces=r"\bnamespace\s*\{", DeleteThis=r"\bdelete\s+this\b", NewArray=r"\bnew\s+[\w:]+\s*\[", WithoutSizeCins=r"\bcin\s*>>"),
]
JAVA = [
    *_words("code", Try="try", Catch="catch", Throw="throw", New="new", Synchronized="synchronized", Instanceof="instanceof", Finalize="finalize", Import="import"),
    *_plain("code", ClassesComparisons=r"\.getClass\s*\(\s*\)\s*(?:==|\.equals)", SystemOutPrint=r"\bSystem\.(?:out|err)\.print", StringComparisons=r"==\s*\"CHAINE\"|\"CHAINE\"\s*==", ImportAll=r"\bimport\s+[\w.]+\.\*"),
]
SQL = [
    *_plain(
        "code",
        Select=r"(?i)\bselect\b",
        SelectAll=r"(?i)\bselect\s+\*",
        SelectDistinct=r"(?i)\bselect\s+distinct\b",
        SQLOrderBy=r"(?i)\border\s+by\b",
        SubQueries=r"(?i)\(\s*select\b",
        Cursor=r"(?i)\bcursor\b",
        Goto=r"(?i)\bgoto\b",
        Exec=r"(?i)\bexec(?:ute)?\b",
        Insert=r"(?i)\binsert\s+into\b",
        Update=r"(?i)\bupdate\b",
        DeleteFrom=r"(?i)\bdelete\b",
        OuterJoin=r"(?i)\b(?:left|right|full)\s+(?:outer\s+)?join\b",
        NonAnsiJoins=r"\(\+\)|\*=|=\*",
        IsNullInWhereClause=r"(?i)\bis\s+null\b",
        NotOpInWhereClause=r"(?i)\bwhere\b[^;]*?\bnot\b",
        ExceptionWhenOthers=r"(?i)\bwhen\s+others\b",
        CommitOrRollback=r"(?i)\b(?:commit|rollback)\b",
    )
]
PYTHON = [
    *_words("code", If="if", Elif="elif", Else="else", For="for", While="while", Try="try", Lambda="lambda", Yield="yield", Global="global", Return="return", Continue="continue", Break="break", Pass="pass"),
    *_plain("code", Functions=r"(?m)^[ \t]*(?:async[ \t]+)?def\b", Classes=r"(?m)^[ \t]*class\b", Import=r"(?m)^[ \t]*(?:import|from)\b", ImportAll=r"(?m)^[ \t]*from\b[^\n]*\bimport[ \t]*\*", BareExcept=r"\bexcept\s*:", Exec=r"\b(?:exec|eval)\s*\(", Decorators=r"(?m)^[ \t]*@\w"),
]
ABAP = _plain(
    "code",
    OnChangeOf=r"(?i)\bon\s+change\s+of\b",
    BreakPoint=r"(?i)\bbreak\b(?:-point\b)?",
    SelectAll=r"(?i)\bselect\s+(?:single\s*)?\*",
    IntoCorrespondingFieldsOf=r"(?i)\binto\s+corresponding\s+fields\s+of\b",
    NativeSQL=r"(?i)\bexec\s+sql\b",
    SystemCall=r"(?i)\bsystem-call\b",
    ReadTable=r"(?i)\bread\s+table\b",
    EndSelect=r"(?i)\bendselect\b",
    If=r"(?i)\bendif\b",
    Loop=r"(?i)\bendloop\b",
)
COBOL = _plain(
    "code",
    GoTo=r"(?i)\bgo\s+to\b",
    Perform=r"(?i)\bperform\b",
    Copy=r"(?i)\bcopy\b",
    Call=r"(?i)\bcall\b",
    ExecSql=r"(?i)\bexec\s+sql\b",
    Occurs=r"(?i)\boccurs\b",
    StopRun=r"(?i)\bstop\s+run\b",
    Paragraphs=r"(?m)^ {7}[\w-]+\.\s*$",
)
SHELL = _plain("code", If=r"\bif\b", Fi=r"\bfi\b", For=r"\bfor\b", While=r"\bwhile\b", Case=r"\bcase\b", Eval=r"\beval\b", Backquotes=r"`[^`\n]+`", Pipes=r"(?<!\|)\|(?!\|)", Exit=r"\bexit\b")
MARKUP = _plain("code", Tags=r"<[A-Za-z][^<>]*>", Scripts=r"(?i)<\s*script\b", Styles=r"(?i)<\s*style\b", Links=r"(?i)<\s*a\b[^>]*\bhref\b", Images=r"(?i)<\s*img\b", Forms=r"(?i)<\s*form\b", Frames=r"(?i)<\s*i?frame\b")

CS = [
    *_words("code", Try="try", Catch="catch", Throw="throw", Finally="finally", New="new", Using="using", Namespace="namespace", Unsafe="unsafe", Lock="lock", Foreach="foreach", Delegate="delegate", Event="event", Sealed="sealed", Partial="partial", Goto="goto", As="as", Is="is", Var="var", Dynamic="dynamic", Async="async", Await="await"),
    *_plain("code", Regions=r"(?m)^[ \t]*#[ \t]*region\b", EmptyCatchesAll=r"\bcatch\s*\{\s*\}", IllegalThrows=r"\bthrow\s+new\s+(?:System\.)?(?:Exception|NullReferenceException|ApplicationException)\b", GCCalls=r"\bGC\.(?:Collect|SuppressFinalize)\s*\(", ConsoleWrites=r"\bConsole\.(?:Write|WriteLine)\s*\(", Destructors=r"~\w+\s*\(\s*\)", Attributes=r"(?m)^[ \t]*\[\w"),
]
JAVA_MORE = [
    *_words("code", Finally="finally", Interfaces="interface", Extends="extends", Implements="implements", Static="static", Abstract="abstract", Volatile="volatile", Transient="transient", Native="native", Assert="assert", Super="super", Package="package"),
    *_plain("code", IllegalThrows=r"\bthrow\s+new\s+(?:Exception|RuntimeException|Error|Throwable)\b", PrimitiveConstructors=r"\bnew\s+(?:Integer|Long|Boolean|Double|Float|Short|Byte|Character)\s*\(", GCCalls=r"\bSystem\.gc\s*\(|\brunFinalization\s*\(", ExitCalls=r"\bSystem\.exit\s*\(", StackTraces=r"\.printStackTrace\s*\(", ThreadCalls=r"\bThread\.(?:sleep|yield)\s*\(", Annotations=r"@[A-Z]\w*", StringBuffers=r"\bnew\s+StringBuffer\b", Vectors=r"\bnew\s+(?:Vector|Hashtable)\b", EmptyStatements=r";\s*;"),
]
JS = [
    *_words("code", Try="try", Catch="catch", Finally="finally", Throw="throw", Function="function", Var="var", Let="let", Const="const", New="new", Delete="delete", Typeof="typeof", Instanceof="instanceof", With="with", Void="void", This="this", Async="async", Await="await", Class="class", Import="import", Export="export", Do="do", Null="null"),
    *_plain("code", Eval=r"\beval\s*\(", Alerts=r"\b(?:alert|confirm|prompt)\s*\(", DocumentWrites=r"\bdocument\.write(?:ln)?\s*\(", ConsoleCalls=r"\bconsole\.\w+\s*\(", Timers=r"\bset(?:Timeout|Interval)\s*\(", LooseEquals=r"[^=!]==[^=]", LooseDiffers=r"!=[^=]", PrototypeChanges=r"\b(?:Array|Object|String|Function|Number)\.prototype\.\w+\s*=", ArrowFunctions=r"=>", ForIn=r"\bfor\s*\(\s*(?:var|let|const)?\s*\w+\s+in\b", InnerHtml=r"\.innerHTML\b", Debuggers=r"\bdebugger\b", StrictModes=r"\"CHAINE\"\s*;", ParseInts=r"\bparseInt\s*\(\s*[^,()]+\)"),
]
TS = _plain("code", Interfaces=r"\binterface\s+\w+", Types=r"\btype\s+\w+\s*=", Enums=r"\benum\s+\w+", AnyTypes=r":\s*any\b", AsCasts=r"\bas\s+\w+", Decorators=r"(?m)^[ \t]*@\w+", Readonlys=r"\breadonly\b", Namespaces=r"\bnamespace\s+\w+", NonNulls=r"\w!\.", Generics=r"\w<\w+>\(")
PHP = [
    *_words("code", Try="try", Catch="catch", Throw="throw", Function="function", Class="class", New="new", Global="global", Echo="echo", Print="print", Foreach="foreach", Elseif="elseif", Include="include", IncludeOnce="include_once", Require="require", RequireOnce="require_once", Die="die", Exit="exit", Isset="isset", Unset="unset", Goto="goto", Var="var", Static="static"),
    *_plain("code", Superglobals=r"\$_(?:GET|POST|REQUEST|COOKIE|SERVER|SESSION|FILES|ENV)\b", Eval=r"\beval\s*\(", ShellLauncherFunctionCalls=r"\b(?:system|exec|passthru|shell_exec|popen|proc_open)\s*\(", ErrorSilencers=r"@\$?\w+\s*[\[(]", MysqlCalls=r"\bmysql_\w+\s*\(", VariableVariables=r"\$\$\w+", Concats=r"\"CHAINE\"\s*\.\s*\"CHAINE\"", ShortTags=r"<\?\s", EndTags=r"\?>"),
]
GO = [
    *_words("code", Func="func", Go="go", Defer="defer", Select="select", Chan="chan", Range="range", Map="map", Struct="struct", Interface="interface", Goto="goto", Fallthrough="fallthrough", Package="package", Import="import", Var="var", Const="const", Panic="panic", Recover="recover", Type="type", Make="make", New="new"),
    *_plain("code", ShortDeclarations=r":=", BlankIdentifiers=r"\b_\s*(?:,|=|:=)", ErrorTests=r"\berr\s*!=\s*nil\b", Methods=r"\bfunc\s*\(\s*\w+\s+\*?\w+\s*\)", EmptyInterfaces=r"\binterface\s*\{\s*\}", FmtPrints=r"\bfmt\.(?:Print|Println|Printf)\s*\(", InitFunctions=r"\bfunc\s+init\s*\(", Sleeps=r"\btime\.Sleep\s*\("),
]
KOTLIN = [
    *_words("code", Fun="fun", Val="val", Var="var", When="when", Object="object", Companion="companion", Data="data", Sealed="sealed", Lateinit="lateinit", Suspend="suspend", Is="is", As="as", In="in", Init="init", Override="override", Open="open", Inline="inline", Null="null"),
    *_plain("code", NotNullAssertions=r"!!", SafeCalls=r"\?\.", Elvis=r"\?:", Lambdas=r"\{\s*\w+(?:\s*,\s*\w+)*\s*->", TopLevelFunctions=r"(?m)^fun\b", UnsafeCasts=r"\bas\s+\w+", PrintCalls=r"\bprint(?:ln)?\s*\(", SemicolonEnds=r"(?m);[ \t]*$"),
]
RUBY = [
    *_words("code", If="if", Unless="unless", Elsif="elsif", Else="else", While="while", Until="until", For="for", Case="case", When="when", Begin="begin", Rescue="rescue", Ensure="ensure", Raise="raise", Def="def", Class="class", Module="module", Yield="yield", Return="return", Next="next", Break="break", Retry="retry", Redo="redo", Nil="nil", Self="self", Require="require"),
    *_plain("code", GlobalVariables=r"\$[a-zA-Z_]\w*", ClassVariables=r"@@\w+", Blocks=r"\bdo\s*\|", Puts=r"\bputs\b", Eval=r"\b(?:instance_|class_|module_)?eval\b", Symbols=r":[a-z_]\w*", RescueAll=r"(?m)\brescue[ \t]*$"),
]
SCALA = [
    *_words("code", Def="def", Val="val", Var="var", Object="object", Trait="trait", Match="match", Implicit="implicit", Lazy="lazy", Yield="yield", Override="override", Null="null", Extends="extends", With="with", Sealed="sealed"),
    *_plain("code", CaseClasses=r"\bcase\s+class\b", WildcardImports=r"\bimport\s+[\w.]+\._", AsInstanceOf=r"\.asInstanceOf\[", IsInstanceOf=r"\.isInstanceOf\[", PrintCalls=r"\bprintln\s*\("),
]
SWIFT = [
    *_words("code", Func="func", Let="let", Var="var", Guard="guard", Struct="struct", Enum="enum", ProtocolWords="protocol", Extension="extension", Defer="defer", Fallthrough="fallthrough", Inout="inout", Weak="weak", Throws="throws", Nil="nil", Self="self", Init="init", Repeat="repeat"),
    *_plain("code", ForcedUnwraps=r"\w!(?:\.|\s|\)|$)", ForcedCasts=r"\bas!", ForcedTries=r"\btry!", OptionalChains=r"\?\.", PrintCalls=r"\bprint\s*\("),
]
RUST = [
    *_words("code", Fn="fn", Let="let", Mut="mut", Match="match", Loop="loop", Impl="impl", Trait="trait", Struct="struct", Enum="enum", Unsafe="unsafe", Pub="pub", Use="use", Mod="mod", Async="async", Await="await", Move="move", Dyn="dyn"),
    *_plain("code", Unwraps=r"\.unwrap\s*\(\s*\)", Expects=r"\.expect\s*\(", Panics=r"\bpanic!", Macros=r"\b\w+!\s*[(\[{]", Clones=r"\.clone\s*\(\s*\)", Lifetimes=r"&\s*mut\b"),
]
SQL_MORE = [*_plain("comment", Hints=r"/\*\+"), *_plain("bare", LikeLeadingWildcards=r"(?i)\blike\s+N?'[%_]"), *_plain(
    "code",
    CreateTable=r"(?i)\bcreate\s+(?:global\s+temporary\s+)?table\b", CreateView=r"(?i)\bcreate\s+(?:or\s+replace\s+)?view\b", CreateIndex=r"(?i)\bcreate\s+(?:unique\s+)?index\b", CreateProcedure=r"(?i)\bcreate\s+(?:or\s+replace\s+)?procedure\b", CreateFunction=r"(?i)\bcreate\s+(?:or\s+replace\s+)?function\b",
    CreateTrigger=r"(?i)\bcreate\s+(?:or\s+replace\s+)?trigger\b", DropStatements=r"(?i)\bdrop\s+(?:table|view|index|procedure|function)\b", AlterTable=r"(?i)\balter\s+table\b", Grants=r"(?i)\bgrant\b", Union=r"(?i)\bunion\b", UnionAll=r"(?i)\bunion\s+all\b", GroupBy=r"(?i)\bgroup\s+by\b",
    Having=r"(?i)\bhaving\b", Exists=r"(?i)\bexists\s*\(", InSubqueries=r"(?i)\bin\s*\(\s*select\b", CompareToNull=r"(?i)(?:=|<>|!=)\s*null\b", Truncate=r"(?i)\btruncate\b", CaseWhen=r"(?i)\bcase\b", CaseElse=r"(?i)\belse\b", Loops=r"(?i)\bloop\b",
    Whiles=r"(?i)\bwhile\b", Ifs=r"(?i)\bif\b", Elsifs=r"(?i)\bels(?:e)?if\b", Fetches=r"(?i)\bfetch\b", Opens=r"(?i)\bopen\b", Closes=r"(?i)\bclose\b", Savepoints=r"(?i)\bsavepoint\b", Raises=r"(?i)\braise\b", Exceptions=r"(?i)\bexception\b", Returns=r"(?i)\breturn\b",
    PositionalOrderBy=r"(?i)\border\s+by\s+\d", CrossJoins=r"(?i)\bcross\s+join\b", CommaJoins=r"(?i)\bfrom\s+\w+\s*(?:\w+\s*)?,\s*\w+", InsertWithoutColumns=r"(?i)\binsert\s+into\s+\w+\s+(?:values|select)\b", UpdateStatements=r"(?i)\bupdate\s+\w+\s+set\b", DynamicSql=r"(?i)\bexecute\s+immediate\b|\bsp_executesql\b",
    LockTables=r"(?i)\block\s+table\b|\bnolock\b", Prints=r"(?i)\b(?:dbms_output\.put_line|print)\b", GlobalVariables=r"@@\w+", TempTables=r"#\w+", Waitfors=r"(?i)\bwaitfor\b", NaturalJoins=r"(?i)\bnatural\s+join\b", Distincts=r"(?i)\bdistinct\b", Merges=r"(?i)\bmerge\s+into\b",
)]
PYTHON_MORE = [
    *_words("code", Except="except", Finally="finally", Raise="raise", Assert="assert", With="with", Del="del", Nonlocal="nonlocal", Async="async", Await="await", NoneWords="None", Is="is", Not="not", And="and", Or="or", In="in"),
    *_plain("code", Prints=r"\bprint\s*\(", CompareToNone=r"[=!]=\s*None\b", CompareToTrue=r"[=!]=\s*(?:True|False)\b", MutableDefaults=r"\bdef\s+\w+\s*\([^)]*=\s*(?:\[\s*\]|\{\s*\})", Comprehensions=r"\[[^\[\]]*\bfor\b[^\[\]]*\]", TypeCalls=r"\btype\s*\([^)]*\)\s*==", SemicolonEnds=r"(?m);[ \t]*$", Backslashes=r"(?m)\\$", DunderMethods=r"\bdef\s+__\w+__", PrivateMethods=r"\bdef\s+_[a-z]\w*", SelfUses=r"\bself\.", Subprocesses=r"\b(?:os\.system|subprocess\.\w+)\s*\(", MultipleStatements=r"(?m);[ \t]*\S", Lists=r"\[\s*\]", BareRaises=r"(?m)\braise[ \t]*$"),
]
SHELL_MORE = [
    *_words("code", Elif="elif", Else="else", Until="until", Done="done", Esac="esac", Function="function", Return="return", Export="export", Source="source", Trap="trap", Read="read", Echo="echo", Printf="printf", Local="local", Shift="shift", Sudo="sudo", Rm="rm", Kill="kill", Sleep="sleep"),
    *_plain("code", Subshells=r"\$\(", Arithmetics=r"\$\(\(", Tests=r"\[\[?\s", Redirects=r">{1,2}", HereDocs=r"<<-?\s*\w+", Positionals=r"\$[0-9@*#]", ErrorExits=r"\bset\s+-\w*e", ForcedRemovals=r"\brm\s+-\w*f", UselessCats=r"\bcat\s+\S+\s*\|", Backgrounds=r"[^&]&\s*\n"),
]
MARKUP_MORE = _plain("code", Tables=r"(?i)<\s*table\b", Inputs=r"(?i)<\s*input\b", Metas=r"(?i)<\s*meta\b", Divs=r"(?i)<\s*div\b", Spans=r"(?i)<\s*span\b", Fonts=r"(?i)<\s*(?:font|center|marquee|blink)\b", Lists=r"(?i)<\s*[uo]l\b", Headings=r"(?i)<\s*h[1-6]\b", InlineHandlers=r"(?i)\son\w+\s*=", InlineStyles=r"(?i)\sstyle\s*=", Anchors=r"(?i)<\s*a\b", Paragraphs=r"(?i)<\s*p\b", Scriptlets=r"<%[^@!=]", Directives=r"<%@", Expressions=r"<%=", Declarations=r"<%!", JstlTags=r"<c:\w+", Objects=r"(?i)<\s*(?:object|embed|applet)\b", Labels=r"(?i)<\s*label\b", Buttons=r"(?i)<\s*button\b")
C_MORE = [
    *_plain("bare", AbsoluteIncludes=r"(?m)^[ \t]*#[ \t]*include[ \t]*[<\"](?:[A-Za-z]:)?[\\/]"),
    *_words("code", Do="do", Sizeof="sizeof", Typedef="typedef", Enum="enum", Static="static", Extern="extern", Volatile="volatile", Register="register", Realloc="realloc", Memcpy="memcpy", Strlen="strlen", Abort="abort", Setjmp="setjmp", Longjmp="longjmp", Void="void", Const="const", Unsigned="unsigned"),
    *_plain("code", Undefs=r"(?m)^[ \t]*#[ \t]*undef\b", SystemIncludes=r"(?m)^[ \t]*#[ \t]*include[ \t]*<", FunctionMacros=r"(?m)^[ \t]*#[ \t]*define[ \t]+\w+\(", ConstantMacros=r"(?m)^[ \t]*#[ \t]*define[ \t]+\w+[ \t]+\d", PointerDeclarations=r"\b\w+\s*\*+\s*\w+\s*[;=,]", NullTests=r"[=!]=\s*NULL\b", EmptyStatements=r";\s*;", AssignmentsInConditions=r"\bif\s*\(\s*\w+\s*=\s*[^=]", Increments=r"\+\+", Decrements=r"--", Arrows=r"->", Labels=r"(?m)^[ \t]*[A-Za-z_]\w*:[ \t]*$"),
]
CPP_MORE = [*_words("code", Throw="throw", Template="template", Virtual="virtual", Friend="friend", Namespace="namespace", Using="using", Class="class", Operator="operator", Inline="inline", Explicit="explicit", Mutable="mutable", Typename="typename", Public="public", Private="private", Protected="protected", This="this", Nullptr="nullptr", Auto="auto", StaticCasts="static_cast", DynamicCasts="dynamic_cast", ConstCasts="const_cast"), *_plain("code", UsingNamespaces=r"\busing\s+namespace\b", Couts=r"\bcout\s*<<", DeleteArrays=r"\bdelete\s*\[\s*\]", CatchAll=r"\bcatch\s*\(\s*\.\.\.\s*\)")]

_C_LIKE_LANGUAGES = [*BASIC, *LONG_LINES, *COMMENTS, *C_LIKE, *FLOW]
_C = [*_C_LIKE_LANGUAGES, *C_CALLS, *C_MORE]
_JVM = [*_C_LIKE_LANGUAGES, *JAVA]
#: The metrics of each language; languages that aren't listed have the basic ones.
PROFILES: dict[str, list[Metric]] = {
    "C": _C,
    **{x: [*_C, *CPP, *CPP_MORE] for x in ("CCpp", "Cpp", "Hpp", "ObjC", "ObjCCpp")},
    "Java": [*_JVM, *JAVA_MORE],
    "Groovy": [*_JVM, *JAVA_MORE],
    "Kotlin": [*_JVM, *KOTLIN],
    "Scala": [*_JVM, *SCALA],
    "CS": [*_C_LIKE_LANGUAGES, *CS],
    "JS": [*_C_LIKE_LANGUAGES, *JS],
    "TypeScript": [*_C_LIKE_LANGUAGES, *JS, *TS],
    "PHP": [*_C_LIKE_LANGUAGES, *PHP],
    "Go": [*_C_LIKE_LANGUAGES, *GO],
    "Swift": [*_C_LIKE_LANGUAGES, *SWIFT],
    "Rust": [*_C_LIKE_LANGUAGES, *RUST],
    "Apex": _C_LIKE_LANGUAGES,
    "Ruby": [*BASIC, *LONG_LINES, *COMMENTS[:1], *RUBY],
    **{x: [*BASIC, *LONG_LINES, *COMMENTS[:1], *SQL, *SQL_MORE] for x in ("PlSql", "TSql", "MySQL", "MariaDB", "PostgreSQL", "DB2")},
    "Python": [*BASIC, *LONG_LINES, Metric("SuspiciousComments", "comment", "fn", lambda c: T.suspicious_lines(c, True)), *PYTHON, *PYTHON_MORE],
    "Abap": [*BASIC, *LONG_LINES, *COMMENTS[:1], *ABAP],
    "Cobol": [*BASIC, *COBOL],
    "Ksh": [*BASIC, *LONG_LINES, *SHELL, *SHELL_MORE],
    **{x: [*BASIC, *LONG_LINES, *MARKUP, *MARKUP_MORE] for x in ("JSP", "HTML")},
}
#: A language's metrics have different names: a later one of a name that is taken is left out.
PROFILES = {language: list({m.name: m for m in reversed(own)}.values())[::-1] for language, own in PROFILES.items()}


def profile(language: str) -> list[Metric]:
    return PROFILES.get(language, BASIC)


def with_views(files: DataFrame, language: str, text: str = "text") -> DataFrame:
    """``files`` with the struct ``views``: text, code, bare (code with its literals), comment, strings and agglo (the line layout)."""
    family = V.FAMILY_OF.get(language, "none")
    views = L.lexical_views(F.col(text), language) if language in L.LEXERS else V.lexical_views(F.col(text), family)
    cut = files.withColumn("views", views)
    return cut.withColumn("views", F.col("views").withField("agglo", V.line_layout(F.col("views.code"), F.col("views.comment"))))


def file_metrics(files: DataFrame, language: str, keys: list[str], text: str = "text", only: list[str] | None = None, findings: bool = True) -> DataFrame:
    """``keys`` and a bigint column for each metric of the language, and for each kind of finding."""
    cut = with_views(files.select(*keys, text), language, text)
    views = {v: F.col(f"views.{v}") for v in ("text", "code", "bare", "comment", "agglo")}
    wanted = [m for m in profile(language) if only is None or m.name in only]
    columns = [m.column(views).alias(m.name) for m in wanted]
    if findings:
        columns += [c.alias(n) for n, c in finding_counts(F.col("views.strings")).items()]
    return cut.select(*keys, *columns)


def long_metrics(wide: DataFrame, keys: list[str], language: str) -> DataFrame:
    """(keys, language, mnemonic, value) from a wide table."""
    names = [c for c in wide.columns if c not in keys]
    pairs = F.array(*[F.struct(F.lit(n).alias("mnemonic"), F.col(f"`{n}`").cast("double").alias("value")) for n in names])
    return wide.select(*keys, F.lit(language).alias("language"), F.inline(pairs))


def string_table(files: DataFrame, language: str, key: str, text: str = "text") -> DataFrame:
    """(key, string_id, literal, uses): each different string literal of a file, numbered by its first place.

    Counted on the map side first; the window numbers one file's different literals. Keys that repeat count
    as one file; null texts have none.
    """
    own = L.lexical_views(F.col(text), language)["strings"] if language in L.LEXERS else V.string_literals(F.col(text), V.FAMILY_OF.get(language, "none"))
    each = files.select(key, F.posexplode(own).alias("place", "literal"))
    one = each.groupBy(key, "literal").agg(F.count("*").alias("uses"), F.min("place").alias("first"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("first", "literal"))
    return one.select(key, number.alias("string_id"), "literal", "uses")


#: Bits of a file's status.
STATUS = {"ok": 0, "no_text": 1, "missing_view": 2, "missing_metric": 4, "too_big": 8}


def status_bits(text: Column, metrics: list[Column]) -> Column:
    """Bits of what went wrong with a file: no text, a metric without a value."""
    missing = F.exists(F.array(*[m.cast("double") for m in metrics]), lambda m: m.isNull())
    return F.when(text.isNull(), F.lit(STATUS["no_text"])).otherwise(0).bitwiseOR(F.when(missing, F.lit(STATUS["missing_metric"])).otherwise(0))


def worst_class(classes: Column) -> Column:
    """Of a group's abort classes: 3 if there are neither 1s nor 2s, else 2 if there is one, else 1."""
    return F.when(~F.bool_or(classes.isin(1, 2)), 3).when(F.bool_or(classes == 2), 2).otherwise(1)


def application_lists(hits: DataFrame, mnemonic: str = "mnemonic", member: str = "member") -> DataFrame:
    """(mnemonic, count, members): different members of each mnemonic, sorted, comma-joined."""
    own = hits.select(mnemonic, member).where(F.col(member).isNotNull()).distinct()
    return own.groupBy(mnemonic).agg(F.count("*").alias("count"), F.array_join(F.array_sort(F.collect_list(member)), ",").alias("members"))


#: What starts a unit of its own in a file, by language.
UNIT_STARTS = {
    **{x: r"(?im)(?=^[ \t]*create\s+(?:or\s+replace\s+)?(?:procedure|function|package|trigger)\b)" for x in ("PlSql", "TSql", "PostgreSQL", "DB2", "MySQL", "MariaDB")},
    "Cobol": r"(?im)(?=^.{0,7}[ \t]*identification\s+division\b)",
}
_UNIT_NAME = r"(?i)^[ \t]*create\s+(?:or\s+replace\s+)?(?:procedure|function|package(?:\s+body)?|trigger)\s+([\w.$#\"\[\]]+)"


def units(files: DataFrame, language: str, key: str, text: str = "text") -> DataFrame:
    """(key, unit: from 1, unit_name, first_line, text): the units of each file; what stands before the first belongs to none. A file without any is one unit."""
    start = UNIT_STARTS.get(language)
    parts = F.split(T.text_of(F.col(text)), start, -1) if start else F.array(T.text_of(F.col(text)))
    ends = F.transform(parts, lambda p: T.line_count(p).cast("int"))
    before = F.concat(F.array(F.lit(0)), T.scan(ends, F.lit(0), lambda a, x: a + x))
    listed = F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda p, n: F.struct(p.alias("text"), (n + 1).alias("first_line")))
    own = F.when(F.size(parts) > 1, F.filter(listed, lambda u: F.rlike(u["text"], F.lit(start)))).otherwise(listed) if start else listed
    each = files.select(key, F.posexplode(own).alias("unit", "u"))
    return each.select(key, (F.col("unit") + 1).alias("unit"), F.regexp_extract("u.text", _UNIT_NAME, 1).alias("unit_name"), "u.first_line", F.col("u.text").alias("text"))


def unit_metrics(files: DataFrame, language: str, key: str, common: list[str], text: str = "text") -> DataFrame:
    """A row for each unit with the metrics of its own text; those named ``common`` are the file's, the same for all its units."""
    own = file_metrics(units(files, language, key, text), language, [key, "unit", "unit_name"], findings=False).drop(*common)
    shared = file_metrics(files, language, [key], text, common, findings=False).withColumnRenamed(key, "__of")
    return own.join(shared, F.col(key) == F.col("__of")).drop("__of")


def with_global_metrics(rows: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """``rows`` with aggregates over all of them in each row (one row is sent to every task). Rows are written first: texts are cut once."""
    rows = written(rows, "rows")
    return rows.join(F.broadcast(rows.agg(*[c.alias(n) for n, c in totals.items()])), how="cross")


def literal_lines(files: DataFrame, language: str, key: str, text: str = "text") -> DataFrame:
    """(key, line, literal): each string literal with the line that it starts on."""
    family = V.FAMILY_OF.get(language, "none")
    if language in L.LEXERS:
        each = files.select(key, F.posexplode(L.token_column(F.col(text), language)).alias("place", "t")).select(key, "place", F.col("t.text").alias("token"), (F.col("t.kind") == L.STRING).alias("is_string"))
    else:
        each = files.select(key, F.posexplode(V.tokens(F.col(text), family)).alias("place", "token")).withColumn("is_string", V.is_string(F.col("token"), family))
    before = F.sum(T.line_count(F.col("token"))).over(Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    marked = each.select(key, "place", F.when(F.col("is_string"), F.col("token")).alias("literal"), (F.coalesce(before, F.lit(0)) + 1).alias("line"))
    return marked.where("literal IS NOT NULL").select(key, "line", "literal")


#: What a line holds whose address literals are no findings: versions, patterns and generated attributes.
ADDRESS_EXCEPTIONS = r"(?i)\bversion\b|\bnew\s+regex\b|\bpattern\b|\bgenerated(?:code)?\b|\bassembly\s*:"


def address_lines(files: DataFrame, language: str, key: str, text: str = "text") -> DataFrame:
    """(key, line, literal): address literals, but for those on lines that say that they are versions or patterns."""
    found = literal_lines(files, language, key, text).where(is_ip(F.col("literal")))
    lines = files.select(F.col(key).alias("__of"), F.posexplode(F.split(T.text_of(F.col(text)), "\n", -1)).alias("n", "code")).where(F.rlike("code", F.lit(ADDRESS_EXCEPTIONS)))
    return found.join(lines, (F.col(key) == F.col("__of")) & (F.col("line") == F.col("n") + 1), "left_anti")
