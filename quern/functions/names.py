"""Names and identities: file types, processor routes, code languages, readable and content-derived ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types by extension.
FILE_TYPES: dict[str, str] = {
    "text": "txt log",
    "json": "json",
    "pdf": "pdf",
    "markdown": "md markdown",
    "doc": "doc docs docx dox doxs dot dotx rtf odt",
    "ppt": "ppt ppts pptx pps ppsx pot potx odp",
    "excel": "xls xlsx xlsm xlt xltx ods",
    "html": "html htm xhtml",
    "csv": "csv tsv",
    "xml": "xml",
    "yaml": "yaml yml",
    "code": "py js ts jsx tsx java c cpp h hpp cs go rb php rs swift kt sh sql",
    "audio": "mp3 wav ogg flac aac m4a wma",
    "image": "jpg jpeg png gif bmp svg webp tiff ico",
    "video": "mp4 avi mov mkv wmv flv webm m4v 3gp",
}
# Splitter languages by extension.
CODE_LANGUAGES: dict[str, str] = {
    "python": "py",
    "js": "js jsx",
    "ts": "ts tsx",
    "go": "go",
    "rust": "rs",
    "c": "c h",
    "cpp": "cpp cc cxx hpp",
    "csharp": "cs",
    "html": "html htm",
    "ruby": "rb",
    "java": "java",
    "kotlin": "kt kts",
    "swift": "swift",
    "scala": "scala",
    "markdown": "md",
    "latex": "tex",
    "sol": "sol",
    "proto": "proto",
    "lua": "lua",
    "perl": "pl pm",
    "powershell": "sh ps1",
}
# Processor routes in order of precedence: name, declared types, path suffixes.
ROUTES: list[tuple[str, str, str]] = [
    ("text", "text txt", "txt"),
    ("pdf", "pdf", "pdf"),
    ("markdown", "markdown md", "md"),
    ("excel", "excel xlsx xls", "xlsx xls"),
    ("json", "json", "json"),
    ("html", "html htm", "html htm"),
    ("yaml", "yaml yml", "yaml yml"),
    ("pptx", "pptx ppt powerpoint", "pptx ppt pptm potx pot"),
    ("docx", "docx doc word", "docx doc docm dotx dot"),
    ("xml", "xml", "xml"),
    ("csv", "csv", "csv"),
]
#: Name space of point ids (RFC 4122, DNS).
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def _inverted(groups: dict[str, str]) -> dict[str, str]:
    return {ext: kind for kind, exts in groups.items() for ext in exts.split()}


def extension(name: Column) -> Column:
    """Lower-case extension after the last dot of a trimmed name; '' where there is none or the dot leads the name."""
    return F.lower(F.regexp_extract(F.trim(name), r"[^./]\.([^./]+)$", 1))


def _lookup(key: Column, groups: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in _inverted(groups).items() for x in pair])[key]


def file_type(name: Column) -> Column:
    """File type of a name by its extension; null if unknown."""
    return _lookup(extension(name), FILE_TYPES)


def code_language(name: Column) -> Column:
    """Splitter language of a code file; null if there is none (as for php and sql)."""
    return _lookup(extension(name), CODE_LANGUAGES)


def processor_route(declared: Column, path: Column) -> Column:
    """The first route whose declared types or path suffixes match, else code, else null. A declared type matches as a
    whole word only."""
    kind, ext = F.lower(F.trim(declared)), extension(path)
    chain = None
    for name, types, suffixes in ROUTES:
        hit = F.coalesce(kind.isin(*types.split()), F.lit(False)) | F.coalesce(ext.isin(*suffixes.split()), F.lit(False))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.when(code_language(path).isNotNull(), "code")


def slug(name: Column, length: int = 15) -> Column:
    return F.substring(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), 1, length)


def project_readable_id(name: Column, salt: Column) -> Column:
    """Ten characters of slug and four of a digest without the characters 0 1 o i l, so that equal inputs give equal ids."""
    return F.concat(slug(name, 10), F.lit("_"), F.substring(F.translate(F.md5(salt), "01oil", "23456"), 1, 4))


def chunk_readable_id(document: Column, number: Column) -> Column:
    return F.concat(document, F.lit("_chunk_"), number.cast("string"))


def parse_two(readable: Column, mark: str) -> Column:
    """The two parts around ``mark`` as an array; null unless there are exactly two."""
    parts = F.split(readable, F.lit(mark))
    return F.when(F.size(parts) == 2, parts)


def node_id(value: Column) -> Column:
    return F.md5(F.lower(F.trim(value)))


def acronym_id(short: Column) -> Column:
    return F.md5(F.upper(short))


def point_id(chunk_id: Column) -> Column:
    """Version 5 UUID of a chunk id."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(chunk_id, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def values_sql(groups: dict[str, str]) -> str:
    """The lookup as a SQL VALUES list (ext, kind)."""
    return ", ".join(f"('{e}', '{k}')" for e, k in _inverted(groups).items())
