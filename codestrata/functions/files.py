"""Column functions on file names, paths and contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The file extensions of each language.
LANGUAGE_EXTENSIONS: dict[str, list[str]] = {
    "Python": ["py", "pyw", "pyi"],
    "Java": ["java"],
    "JavaScript": ["js", "jsx", "mjs", "cjs"],
    "TypeScript": ["ts", "tsx", "d.ts"],
    "Go": ["go"],
    "C": ["c", "h"],
    "C++": ["cpp", "cc", "cxx", "c++", "hpp", "hh", "hxx"],
    "Rust": ["rs"],
    "Kotlin": ["kt", "kts"],
    "Swift": ["swift"],
    "PHP": ["php", "phtml"],
    "Ruby": ["rb", "rake", "gemspec"],
    "Markdown": ["md", "mdx", "markdown"],
    "JSON": ["json", "jsonc", "json5"],
    "YAML": ["yaml", "yml"],
    "Terraform": ["tf", "tfvars"],
    "Shell": ["sh", "bash", "zsh", "fish", "ksh"],
    "HTML": ["html", "htm", "xhtml"],
    "CSS": ["css", "scss", "sass", "less"],
    "SQL": ["sql", "ddl", "dml"],
}

# The MIME type of each extension.
MIME_EXTENSIONS: dict[str, list[str]] = {
    "text/x-python": ["py", "pyw", "pyi"],
    "text/x-java-source": ["java"],
    "application/javascript": ["js", "mjs", "cjs"],
    "text/jsx": ["jsx"],
    "application/typescript": ["ts"],
    "text/tsx": ["tsx"],
    "text/x-go": ["go"],
    "text/x-csrc": ["c"],
    "text/x-chdr": ["h"],
    "text/x-c++src": ["cpp", "cc", "cxx"],
    "text/x-c++hdr": ["hpp", "hh"],
    "text/x-rustsrc": ["rs"],
    "text/x-kotlin": ["kt", "kts"],
    "text/x-swift": ["swift"],
    "text/x-php": ["php"],
    "text/x-ruby": ["rb"],
    "application/x-sh": ["sh", "bash", "zsh"],
    "text/html": ["html", "htm"],
    "application/xhtml+xml": ["xhtml"],
    "text/css": ["css"],
    "text/x-scss": ["scss"],
    "text/x-sass": ["sass"],
    "text/x-less": ["less"],
    "text/markdown": ["md", "mdx", "markdown"],
    "application/json": ["json", "jsonc"],
    "application/x-yaml": ["yaml", "yml"],
    "application/xml": ["xml"],
    "application/sql": ["sql"],
    "text/x-terraform": ["tf", "tfvars"],
    "application/toml": ["toml"],
    "text/plain": ["ini", "cfg", "conf", "env", "txt"],
    "text/x-rst": ["rst"],
    "application/zip": ["zip"],
    "application/x-tar": ["tar"],
    "application/gzip": ["gz"],
    "application/x-7z-compressed": ["7z"],
    "application/vnd.microsoft.portable-executable": ["exe", "dll"],
    "application/x-sharedlib": ["so"],
    "application/x-archive": ["a"],
    "application/x-object": ["o"],
    "application/octet-stream": ["pyc"],
    "application/java-vm": ["class"],
    "image/png": ["png"],
    "image/jpeg": ["jpg", "jpeg"],
    "image/gif": ["gif"],
    "image/x-icon": ["ico"],
    "image/svg+xml": ["svg"],
    "image/webp": ["webp"],
}
DEFAULT_MIME = "application/octet-stream"

# Directories that a scan does not enter, extensions it does not read, and binary extensions.
IGNORED_DIRECTORIES = [
    ".git", ".github", ".gitlab", ".idea", ".vscode", "node_modules", "venv", ".venv", "dist", "build", "coverage", ".cache", ".next",
    "target", "__pycache__", "bin", "obj", "vendor",
]
IGNORED_EXTENSIONS = [
    "pyc", "class", "exe", "dll", "so", "o", "a", "png", "jpg", "jpeg", "gif", "ico", "zip", "tar", "gz", "7z",
]
BINARY_EXTENSIONS = [
    "pyc", "class", "exe", "dll", "so", "o", "a", "zip", "tar", "gz", "7z", "jar", "war", "ear", "whl", "egg", "pdf", "doc", "docx", "xls",
    "xlsx", "ppt", "pptx", "db", "sqlite", "sqlite3", "png", "jpg", "jpeg", "gif", "ico", "bmp", "tiff", "webp", "mp3", "mp4", "avi", "mov",
    "mkv", "wav", "flac", "ogg", "woff", "woff2", "ttf", "otf", "eot",
]

MAX_FILE_BYTES = 10 * 1024 * 1024
SNIFF_BYTES = 8192
MAX_DEPTH = 50


def _pairs(table: dict[str, list[str]]) -> dict[str, str]:
    """Extension to value."""
    return {key: value for value, keys in table.items() for key in keys}


def _lookup(key: Column, pairs: dict[str, str], default: str) -> Column:
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*flat), key), F.lit(default))


def slashed(path: Column) -> Column:
    """The path with forward slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def file_name(path: Column) -> Column:
    """What stands behind the last separator, a slash or a backslash."""
    return F.element_at(F.split(slashed(path), "/"), -1)


def extension(name: Column) -> Column:
    """Last segment of the name in lower case; ``d.ts`` counts as one; '' for names without one or hidden names."""
    last = F.lower(F.element_at(F.split(name, r"\."), -1))
    dotted = F.lower(name).rlike(r"^.+\.d\.ts$")
    return F.when(~name.contains("."), F.lit("")).when(name.rlike(r"^\.[^.]*$"), F.lit("")).when(dotted, F.lit("d.ts")).otherwise(last)


def language(name: Column, ext: Column) -> Column:
    """Dockerfiles by name, others by extension; Unknown without an entry."""
    docker = (F.lower(name) == "dockerfile") | F.lower(name).startswith("dockerfile.")
    return F.when(docker, F.lit("Dockerfile")).otherwise(_lookup(F.lower(ext), _pairs(LANGUAGE_EXTENSIONS), "Unknown"))


def mime_type(ext: Column) -> Column:
    return _lookup(F.lower(ext), _pairs(MIME_EXTENSIONS), DEFAULT_MIME)


def is_binary(ext: Column, content: Column) -> Column:
    """A binary extension, a NUL byte among the first bytes, or a content that could not be read."""
    nul = F.hex(F.substring(content, 1, SNIFF_BYTES)).rlike("^(?:..)*?00")
    return ext.isin(BINARY_EXTENSIONS) | content.isNull() | nul


def is_hidden(path: Column) -> Column:
    """Some part of the path starts with a dot (``.`` and ``..`` are no names)."""
    return F.exists(F.split(path, "/"), lambda p: p.startswith(".") & ~p.isin(".", ".."))


def in_ignored_directory(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.isin(IGNORED_DIRECTORIES))


def human_bytes(n: Column) -> Column:
    """``0 B``, ``1.5 KB``, ... in powers of 1024."""
    power = F.when(n <= 0, F.lit(0)).otherwise(F.least(F.lit(4), F.floor(F.log(1024.0, n.cast("double")) + F.lit(1e-9)).cast("int")))
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")]), power + 1)
    return F.concat(F.format_string("%.1f", n / F.pow(F.lit(1024.0), power.cast("double"))), F.lit(" "), unit)


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 8)


def relative_time(at: Column, now: Column) -> Column:
    """Just now, 5m ago, 3h ago, 2d ago."""
    s = F.unix_timestamp(now) - F.unix_timestamp(at)
    step = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    return (
        F.when(s < 60, F.lit("just now")).when(s < 3600, step(60, "m ago")).when(s < 86400, step(3600, "h ago")).otherwise(step(86400, "d ago"))
    )


def sha256_of(content: Column, binary: Column) -> Column:
    """SHA-256 of text that is not empty; null otherwise."""
    return F.when(~binary & (F.octet_length(content) > 0), F.sha2(content, 256))


def decoded(content: Column) -> Column:
    """Text of the bytes of a file: UTF-8, or Latin-1 where they are none."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
