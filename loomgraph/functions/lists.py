"""Fixed values of the analysis: names, markers and file endings."""

# Names that are never reported as unused.
ALWAYS_USED = (
    "main", "__init__", "__main__", "__new__", "__del__",
    "__str__", "__repr__", "__eq__", "__ne__", "__lt__",
    "__le__", "__gt__", "__ge__", "__hash__", "__bool__",
    "__len__", "__getitem__", "__setitem__", "__delitem__",
    "__iter__", "__next__", "__contains__", "__enter__",
    "__exit__", "__call__", "__get__", "__set__", "__delete__",
    "__add__", "__sub__", "__mul__", "__truediv__", "__floordiv__",
    "__mod__", "__pow__", "__and__", "__or__", "__xor__",
    "__lshift__", "__rshift__", "__neg__", "__pos__", "__abs__",
    "__invert__", "__iadd__", "__isub__", "__imul__",
    "__getattr__", "__setattr__", "__delattr__",
    "__class_getitem__", "__init_subclass__",
    "setup", "teardown", "setUp", "tearDown",
)

# Folders that a scan leaves out (so does one that ends in .egg-info).
SKIPPED_FOLDERS = (
    ".venv", "venv", "env", ".env",
    "__pycache__", ".git", ".hg", ".svn",
    "node_modules", ".tox", ".mypy_cache",
    ".pytest_cache", "dist", "build",
    ".loomgraph",
)

# Calls whose result comes from outside.
TAINT_SOURCES = (
    "request.get", "request.form", "request.args", "request.json",
    "request.data", "request.values", "request.files",
    "input", "raw_input",
    "sys.stdin.read", "sys.stdin.readline",
    "os.environ.get", "os.environ",
    "open", "read", "readline", "readlines",
)

# Calls that mustn't get such a result.
TAINT_SINKS = (
    "db.execute", "cursor.execute", "connection.execute",
    "os.system", "os.popen",
    "subprocess.run", "subprocess.call", "subprocess.Popen", "subprocess.check_output",
    "eval", "exec", "compile",
    "open().write", "write",
)

# Calls that make it safe.
SANITIZERS = (
    "sanitize", "escape", "html.escape", "markupsafe.escape",
    "bleach.clean", "urllib.parse.quote",
    "parameterize", "quote", "sanitize_input",
    "int", "float", "bool",
)

# The language of each file ending.
LANGUAGES = {
    "py": "python",
    "js": "javascript",
    "jsx": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "go": "go",
    "rs": "rust",
    "java": "java",
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "cc": "cpp",
    "cxx": "cpp",
    "hpp": "cpp",
    "hh": "cpp",
    "rb": "ruby",
}

# Kinds shown without parameters, and short names of kinds.
TYPE_KINDS = ("class", "struct", "interface", "trait", "enum", "type")
SHORT_KINDS = {"class": "cls", "struct": "str", "interface": "ifc", "trait": "trt", "enum": "enm", "type": "typ", "function": "fn", "method": "mth"}

# Folders of tests.
TEST_FOLDERS = ("test", "tests", "spec", "__tests__")
