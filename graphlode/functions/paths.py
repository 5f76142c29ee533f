"""Predicates and lookups on file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension and language (fixed values).
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "tsx": "tsx", "jsx": "jsx", "go": "go", "java": "java",
    "cs": "csharp", "vb": "vbnet", "ml": "minilang", "mlinc": "minilang", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "cpp", "c": "c",
    "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml",
    "aspx": "aspx", "ascx": "aspx", "master": "aspx", "asmx": "aspx", "ashx": "aspx", "svc": "aspx", "asax": "aspx",
    "config": "xml", "xml": "xml", "csproj": "xml", "vbproj": "xml", "rdlc": "xml", "rdl": "xml", "dbml": "xml", "edmx": "xml",
    "sql": "sql", "asp": "asp_classic",
}
#: Languages told apart beyond those.
FURTHER = {"html": "html", "htm": "html", "css": "css", "sh": "shell", "ps1": "powershell", "toml": "toml", "rb": "ruby", "php": "php"}


def normal_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: Column) -> Column:
    lookup = F.create_map(*(F.lit(x) for pair in (LANGUAGES | FURTHER).items() for x in pair))
    return F.coalesce(F.element_at(lookup, extension(path)), F.lit("text"))


def is_vendor(path: Column) -> Column:
    """Package folders, minified or bundled files, and versioned copies of one library (fixed values)."""
    p = F.lower(normal_path(path))
    folder = p.rlike(r"(^|/)(node_modules|bower_components|jspm_packages|vendor|vendors|packages)(/|$)|wwwroot/lib/")
    return folder | p.rlike(r"\.(min\.js|min\.css|min\.map|bundle\.js|umd\.js)$|(^|/)jquery-(\d|ui-)[^/]*$")


def is_declaration(path: Column) -> Column:
    return F.lower(path).rlike(r"\.d\.ts$|(^|/)typings/")


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(tests?|specs?|__tests__)/|(_test|\.test|\.spec|tests?)\.[a-z]+$")


def is_generated(path: Column) -> Column:
    return F.lower(path).rlike(r"\.designer\.[a-z]+$|\.g\.[a-z]+$|\.generated\.[a-z]+$|(^|/)(obj|bin|dist|generated)/")


def has_generated_header(content: Column, lines: int = 20) -> Column:
    """Whether one of the first lines says that a program wrote the file."""
    head = F.lower(F.substring_index(content, "\n", lines))
    return head.rlike("<auto-generated|this code was generated|do not edit")


def glob_to_regex(glob: str) -> str:
    """A regular expression for a glob; ``**`` crosses folders, ``*`` and ``?`` do not, slashes of both kinds are one."""
    out, i = "", 0
    glob = glob.replace("\\", "/")
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in r".+()[]{}^$|" else glob[i]), i + 1
    return f"^{out}$"


def matches_scope(path: Column, scope: str) -> Column:
    """A rule's scope: a glob if it holds a wildcard, else a substring."""
    p = normal_path(path)
    if any(c in scope for c in "*?"):
        return p.rlike("(?i)" + glob_to_regex(scope))
    return F.contains(F.lower(p), F.lit(scope.replace("\\", "/").lower()))
