"""Formatting and path functions on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"
# The characters that are white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# File extensions and the hint of each.
LANG_HINTS = {
    "rs": "rust", "ts": "ts", "tsx": "ts", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "go": "go", "py": "py", "java": "java", "kt": "kotlin", "kts": "kotlin",
    "rb": "ruby", "php": "php", "cs": "csharp", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "swift": "swift", "scala": "scala",
    "sh": "bash", "bash": "bash", "zsh": "bash", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "md": "md", "sql": "sql",
}
LANGUAGES = {"ts": "ts", "tsx": "ts", "js": "ts", "mjs": "ts", "cjs": "ts", "go": "go", "rs": "rust"}


def strip(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(WHITE))


def format_ns(ns: Column) -> Column:
    """A duration in the most readable unit; a dash if it isn't finite."""
    finite = ns.isNotNull() & ~F.isnan(ns) & (F.abs(ns) != float("inf"))
    shown = (
        F.when(ns < 1e3, F.format_string("%.0fns", ns))
        .when(ns < 1e6, F.format_string("%.2fµs", ns / 1e3))
        .when(ns < 1e9, F.format_string("%.2fms", ns / 1e6))
        .otherwise(F.format_string("%.2fs", ns / 1e9))
    )
    return F.when(finite, shown).otherwise(DASH)


def format_pct(fraction: Column) -> Column:
    """A share, with more digits the smaller it is."""
    size = F.abs(fraction)
    v = fraction * 100
    return F.when(fraction.isNull(), None).when(size < 0.001, F.format_string("%.2f%%", v)).when(size < 0.01, F.format_string("%.1f%%", v)).otherwise(F.format_string("%.0f%%", v))


def format_signed_pct(fraction: Column) -> Column:
    # format_string shows a null as a word.
    return F.when(fraction.isNotNull(), F.concat(F.when(fraction > 0, "+").otherwise(""), F.format_string("%.1f%%", fraction * 100)))


def format_p(p: Column) -> Column:
    """A probability with three digits and a power of ten."""
    shown = F.format_string("%.2e", p)
    # One digit of the exponent where one is enough, and no sign but a minus.
    return F.when(p.isNotNull(), F.regexp_replace(shown, r"e([-]?)\+?0*(\d)", "e$1$2"))


def short_ref(ref: Column) -> Column:
    """The first seven characters of a name of a version."""
    return F.left(ref, F.lit(7))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def language_of(path: Column) -> Column:
    """Language of a source file by its extension; null if it is none that is followed."""
    return _lookup(LANGUAGES, extension(path))


def lang_hint(path: Column) -> Column:
    """Hint of what stands after the path's last dot, in the case that it has; empty if it is none that is known."""
    return F.coalesce(_lookup(LANG_HINTS, F.when(F.instr(path, ".") > 0, F.substring_index(path, ".", -1))), F.lit(""))


def normalize_path(path: Column) -> Column:
    """The path without '.' and '..' parts, by text alone; '..' at the top is dropped."""

    def step(acc: Column, part: Column) -> Column:
        return F.when((part == "") | (part == "."), acc).when(part == "..", F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def glob_to_regex(pattern: str) -> str:
    """Anchored regular expression of a glob: ** crosses separators and swallows one that follows, * and ? do not."""
    out, i = "^", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out += ".*"
            i += 3 if pattern[i + 2 : i + 3] == "/" else 2
            continue
        c = pattern[i]
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in ".+()[]{}^$|\\" else c)
        i += 1
    return out + "$"


def truncate_middle(body: Column, limit: int) -> Column:
    """A text over limit bytes (UTF-8) loses its middle, at line ends, and says how many bytes it lost.

    Front and back have limit // 2 bytes each, or up to three fewer where that is inside a character; the front ends
    before its last line feed, the back begins after its first one.
    """
    half = limit // 2
    data = F.encode(body, "UTF-8")
    size = F.octet_length(body)

    def inside(place: Column) -> Column:
        """Whether the byte at a place (from 1) goes on with a character."""
        byte = F.hex(F.substring(data, place, F.lit(1)))
        return (byte >= "80") & (byte <= "BF")

    ends = [max(0, half - back) for back in range(4)]
    end = F.coalesce(*[F.when(~inside(F.lit(e + 1)), F.lit(e)) for e in ends[:3]], F.lit(ends[3]))
    front = F.substring(data, F.lit(1), end).cast("string")
    # Place of the front's last line feed, if any.
    back_at = F.instr(F.reverse(front), "\n")
    head = F.when(back_at > 0, F.left(front, F.char_length(front) - back_at)).otherwise(front)
    begins = [size - half + 1 + ahead for ahead in range(4)]
    begin = F.coalesce(*[F.when(~inside(at), at) for at in begins[:3]], begins[3])
    rest = F.substring(data, begin, size).cast("string")
    next_line = F.instr(rest, "\n")
    tail = F.when(next_line > 0, F.substring(rest, next_line + 1, F.lit(1 << 30))).otherwise(rest)
    elided = size - F.octet_length(head) - F.octet_length(tail)
    cut = F.concat(head, F.lit("\n... [truncated "), elided.cast("string"), F.lit(" bytes — file too large] ...\n"), tail)
    return F.when(size <= limit, body).otherwise(cut)


def sanitise(text: Column) -> Column:
    """One line without control characters or code fences, runs of white space as one space."""
    plain = F.regexp_replace(text, r"[\p{Cc}&&[^\t]]", " ")
    broken = F.replace(plain, F.lit("```"), F.lit("`​`​`"))
    return strip(F.regexp_replace(broken, r"(?U)\s+", " "))
