"""Column functions over note texts and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What results must agree with.
TOKEN = "[a-z0-9áéíóúüñ]+"
STOP_WORDS = (
    "de la el los las un una unos unas y o u en con por para del al que se su sus es son como mas más pero "
    "the of to in and or a an at on for no si sí ya muy sin sobre entre desde hasta este esta esto ese esa "
    "todo todos cada mi tu va van hay"
).split()
BINARY_EXTENSIONS = (
    "pdf png jpg jpeg gif webp bmp ico tiff zip gz tar 7z rar xz bz2 mp3 mp4 m4a mov avi wav ogg webm "
    "xlsx xls docx doc pptx odt ods ttf otf woff woff2 bin exe dmg iso"
).split()
OPEN_LINK = r"(?m)^\[Open in Obsidian\]\(obsidian://[^)]+\)(?:\n\n---\n\n)?"
SYNONYMS = {
    "reunion": ["meeting", "encuentro", "junta", "sesion"],
    "meeting": ["reunion", "encuentro", "junta"],
    "tarea": ["task", "pendiente", "todo", "accion"],
    "task": ["tarea", "pendiente", "todo"],
    "proyecto": ["project", "iniciativa"],
    "project": ["proyecto", "iniciativa"],
    "nota": ["note", "apunte"],
    "note": ["nota", "apunte"],
    "trabajo": ["job", "laboral", "empleo"],
    "idea": ["concepto", "propuesta", "sugerencia"],
    "error": ["bug", "fallo", "fail", "issue"],
    "bug": ["error", "fallo", "fail", "issue"],
    "instalar": ["install", "setup", "deploy", "configurar"],
    "docker": ["contenedor", "container"],
    "container": ["docker", "contenedor"],
    "servidor": ["server", "host", "maquina"],
    "server": ["servidor", "host"],
    "archivo": ["file", "fichero"],
    "file": ["archivo", "fichero"],
    "config": ["configuracion", "conf", "settings", "ajustes"],
    "usuario": ["user", "cuenta"],
    "user": ["usuario", "cuenta"],
    "password": ["pass", "clave", "secret", "contrasena"],
    "clave": ["password", "pass", "secret"],
    "base": ["database", "db", "datos"],
    "database": ["base", "db", "datos"],
    "script": ["programa", "codigo", "automatizacion"],
    "red": ["network", "lan", "vlan"],
    "network": ["red", "lan"],
    "backup": ["respaldo", "copia"],
    "respaldo": ["backup", "copia"],
    "log": ["registro", "logs", "bitacora"],
    "registro": ["log", "logs"],
}


def strip(text: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_note_text(text: Column) -> Column:
    """Without the link that a note server puts before the text, nor line breaks at its start."""
    return F.regexp_replace(F.regexp_replace(text, OPEN_LINK, ""), r"\A\n+", "")


def tokenize(text: Column) -> Column:
    """Lower-case tokens; letters outside the token's alphabet separate."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def key_terms(text: Column) -> Column:
    """Tokens with content; all tokens where none has."""
    tokens = tokenize(text)
    stop = F.array(*map(F.lit, STOP_WORDS))
    kept = F.filter(tokens, lambda t: ~F.array_contains(stop, t) & (F.length(t) > 1))
    return F.when(F.size(kept) == 0, tokens).otherwise(kept)


def content_hash(text: Column) -> Column:
    return F.sha1(F.coalesce(text, F.lit("")))


def excerpt(text: Column, n: int = 6000) -> Column:
    return F.substring(text, 1, n)


def embed_text(path: Column, heading: Column, text: Column) -> Column:
    """What is embedded of a chunk."""
    return F.concat(path, F.lit(" :: "), F.coalesce(heading, F.lit("")), F.lit(" :: "), text)


def embed_query(query: Column) -> Column:
    return F.concat(F.lit(":: "), query)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def base_name(path: Column) -> Column:
    """Lower-case name without folder and without its last extension."""
    return F.lower(F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]*$", ""))


def folder(path: Column) -> Column:
    """Folder of a path, empty at the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def is_binary(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*BINARY_EXTENSIONS)


def decode_payload(path: Column, content: Column) -> Column:
    """Bytes of a stored file: UTF-8 of a text; of a binary file its base64 blocks, each decoded by itself, joined."""
    packed = F.regexp_replace(content, r"\s+", "")
    blocks = F.filter(F.split(packed, "(?<==)(?=[A-Za-z0-9+/])"), lambda b: b != "")
    joined = F.aggregate(blocks, F.lit(b""), lambda acc, b: F.concat(acc, F.unbase64(b)))
    return F.when(is_binary(path), joined).otherwise(content.cast("binary"))


def front_matter(text: Column) -> Column:
    """The front matter's top-level keys with their values as they stand (nested lines too); the first of a repeated key; empty without any."""
    front = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\A---\n(.*?)\n---", 1)
    entries = F.transform(F.regexp_extract_all(front, F.lit(r"(?m)^([^\s:#-][^:\n]*:(?:[ \t][^\n]*|(?=\n|\z))(?:\n(?:[ \t]|-)[^\n]*)*)"), F.lit(1)), lambda e: F.struct(
        F.trim(F.regexp_extract(e, r"\A([^:]*):", 1)).alias("key"), strip(F.regexp_extract(e, r"(?s)\A[^:]*:(.*)\z", 1)).alias("value"),
    ))
    keys = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1))


def tags(text: Column) -> Column:
    """Distinct tags, sorted: front matter ``tags:`` (inline list or items) and ``#tag`` outside fences."""
    front = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    inline = F.split(F.regexp_extract(front, r"(?m)^tags:[ \t]*\[?([^\]\n]*)", 1), r"[,\s]+")
    items = F.regexp_extract_all(F.regexp_extract(front, r"(?m)^tags:[ \t]*\n((?:[ \t]*-[^\n]*\n?)+)", 1), F.lit(r"-[ \t]*([^\n]+)"), F.lit(1))
    body = F.regexp_replace(text, r"(?s)```.*?(?:```|\z)", "")
    marks = F.regexp_extract_all(body, F.lit(r"(?:^|\s)#([A-Za-z][A-Za-z0-9_/\-]*)"), F.lit(1))
    every = F.transform(F.concat(inline, items, marks), lambda t: F.regexp_replace(F.trim(t), r"^[\"'#]+|[\"']+$", ""))
    return F.array_sort(F.array_distinct(F.filter(every, lambda t: t != "")))
