"""The chunkers as one pass over the lines of a note: what the library's chunks are held against."""

import re

_HEADING, _HEADING_OR_BLANK = re.compile(r"(#{1,6})\s+(.+)$"), re.compile(r"(#{1,6})\s+(.*)")
_ROW, _ITEM, _INDEX_ITEM = re.compile(r"\|.+\|"), re.compile(r"\s*(?:[-*+]|\d+\.)\s"), re.compile(r"\s*(?:[-*]|\d+\.)\s")
#: A longer code chunk is cut where this many characters have gathered.
_LONG_CODE, _CODE_PART = 4000, 3000


class _Open:
    """Chunks so far, and the lines of the one being read."""

    def __init__(self, heading: str | None):
        self.done: list[tuple[str | None, int, str, str]] = []
        self.lines: list[str] = []
        self.heading, self.level, self.kind = heading, 0, "prose"

    def close(self, keep=lambda text: True) -> None:
        text = "\n".join(self.lines).strip()
        self.lines = []
        if text and keep(text):
            self.done.append((self.heading, self.level, self.kind, text))

    def turn(self, kind: str) -> None:
        self.close()
        self.kind = kind


def _code_parts(text: str) -> list[str]:
    parts, held, size = [], [], 0
    for line in text.split("\n"):
        held.append(line)
        size += len(line) + 1
        if size >= _CODE_PART:
            parts.append("\n".join(held).strip())
            held, size = [], 0
    return parts + (["\n".join(held).strip()] if held else [])


def semantic_chunks(text: str | None, min_chars: int = 80) -> list[tuple]:
    """(heading, level, type, text) in order: code, tables and lists by themselves, short prose joined to what follows."""
    text = text or ""
    if len(text.strip()) < min_chars:
        return [("", 0, "prose", text.strip())]
    now, fenced = _Open(""), False
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith(("```", "~~~")):
            if not fenced:
                now.turn("code")
            now.lines.append(line)
            if fenced:
                now.turn("prose")
            fenced = not fenced
            continue
        if fenced:
            now.lines.append(line)
            continue
        head = _HEADING.match(bare)
        if head:
            now.turn("prose")
            now.heading, now.level = head[2].strip(), len(head[1])
            continue
        kind = "table" if _ROW.match(bare) else "list" if _ITEM.match(line) else now.kind if not bare else "prose"
        if kind != now.kind:
            now.turn(kind)
        now.lines.append(line)
    now.close()
    cut = [(h, lv, k, p) for h, lv, k, t in now.done for p in (_code_parts(t) if k == "code" and len(t) > _LONG_CODE else [t])]
    out: list[tuple] = []
    for c in cut:
        if out and len(out[-1][3]) < min_chars and out[-1][2] == c[2] == "prose":
            out[-1] = (*out[-1][:3], f"{out[-1][3]}\n\n{c[3]}")
        else:
            out.append(c)
    return out or [("", 0, "prose", text.strip()[:2000])]


def index_chunks(text: str | None, min_chars: int = 120, keep_short: bool = True) -> list[tuple]:
    """As ``semantic_chunks``, finer: a chunk for each table row and list item, headings stay in the text.

    ``keep_short=False`` drops prose below ``min_chars`` unless it is a note's first chunk.
    """
    text = text or ""
    if len(text.strip()) < 20:
        return []
    now, fenced = _Open(None), False
    keep = lambda t: keep_short or len(t) >= min_chars or not now.done or now.kind != "prose"
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith("```"):
            if not fenced:
                now.close(keep)
                now.kind = "code"
            now.lines.append(line)
            if fenced:
                now.close(keep)
                now.kind = "prose"
            fenced = not fenced
        elif fenced:
            now.lines.append(line)
            if sum(map(len, now.lines)) > _CODE_PART:
                now.close(keep)
        elif head := _HEADING_OR_BLANK.match(line):
            now.close(keep)
            now.heading, now.level, now.kind = head[2].strip(), len(head[1]), "prose"
            now.lines.append(line)
        elif bare.startswith("|") or _INDEX_ITEM.match(line):
            now.close(keep)
            now.kind = "table" if bare.startswith("|") else "list"
            now.lines.append(line)
        elif bare:
            now.lines.append(line)
        else:
            now.close(keep)
    now.close(keep)
    return now.done
