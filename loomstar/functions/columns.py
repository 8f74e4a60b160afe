"""Keys, categories, calendar, words, paths, snippets and patterns as plain column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstar.functions import fixed

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: What Python's strip() takes from both ends.
ENDS = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"


def strip(text: Column) -> Column:
    """The text without white space at its ends, of any kind that Python knows."""
    return F.regexp_replace(text, ENDS, "")


def lookup(value: Column, table: dict[str, str], default: Column | str | None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[value], default if isinstance(default, Column) else F.lit(default))


def dimension_key(*parts: Column) -> Column:
    """MD5 of the parts joined by bars; a null part counts as NULL."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("NULL")) for p in parts]))


def tool_category(name: Column) -> Column:
    return lookup(name, fixed.TOOL_CATEGORIES, "other")


def model_family(name: Column) -> Column:
    out = F.lit("unknown")
    for family in reversed(fixed.MODEL_FAMILIES):
        out = F.when(F.contains(F.lower(name), F.lit(family)), family).otherwise(out)
    return out


def time_of_day(hour: Column) -> Column:
    return F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")


def operation_type(tool: Column) -> Column:
    return lookup(F.lower(tool), {"read": "read", "write": "write", "edit": "edit", "multiedit": "edit", "glob": "list", "grep": "search"}, "other")


def date_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd").cast("int")


def time_key(ts: Column) -> Column:
    return F.date_format(ts, "HHmm").cast("int")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def estimated_tokens(text: Column) -> Column:
    """1.5 tokens a word where the text looks like code, else 1.3."""
    code = F.contains(text, F.lit("```")) | F.contains(text, F.lit("def ")) | F.contains(text, F.lit("function "))
    return F.floor(word_count(text) * F.when(code, F.lit(1.5)).otherwise(F.lit(1.3))).cast("int")


def bare(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=.)/+$", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(bare(path), "/"), -1)


def file_extension(path: Column) -> Column:
    """The last suffix; none for a dotfile or a name that ends with a dot."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def directory_path(path: Column) -> Column:
    up = F.regexp_extract(bare(path), r"(?s)^(.*)/[^/]*$", 1)
    return F.when(~F.contains(bare(path), F.lit("/")), ".").when(up == "", "/").otherwise(up)


def language_of_extension(path: Column) -> Column:
    by = {ext: name for name, exts in fixed.LANGUAGE_EXTENSIONS.items() for ext in exts if ext.startswith(".")}
    return F.when(file_name(path) == "Dockerfile", "dockerfile").otherwise(lookup(file_extension(path), by, "unknown"))


def language_of_hint(hint: Column) -> Column:
    clean = F.trim(F.lower(hint))
    return F.when(F.coalesce(clean, F.lit("")) == "", "unknown").otherwise(lookup(clean, fixed.HINT_ALIASES, clean))


def code_blocks(text: Column) -> Column:
    """Array of struct language, code (trimmed of nothing), of each fenced block."""
    found = [F.regexp_extract_all(text, F.lit("(?s)" + fixed.CODE_FENCE), F.lit(g)) for g in (1, 2)]
    return F.transform(F.arrays_zip(found[0].alias("hint"), found[1].alias("code")), lambda b: F.struct(language_of_hint(b["hint"]).alias("language"), b["code"].alias("code")))


def line_count(code: Column) -> Column:
    return F.when(F.regexp_replace(code, SPACE, "") == "", 0).otherwise(F.length(code) - F.length(F.replace(code, F.lit("\n"), F.lit(""))) + 1)


def snippet(text: Column, query: Column | None = None, size: int = fixed.SNIPPET) -> Column:
    """A window of the text around the first match, ignoring case, with dots where it was cut."""
    plain = F.concat(F.substring(text, 1, size), F.lit("..."))
    if query is not None:
        at = F.instr(F.lower(text), F.lower(query))
        start = F.greatest(F.lit(0), at - 1 - size // 2)
        end = F.least(F.length(text), start + size)
        start = F.when(end == F.length(text), F.greatest(F.lit(0), end - size)).otherwise(start)
        cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "...").otherwise(""))
        plain = F.when(at > 0, cut).otherwise(plain)
    return F.when(F.length(text) <= size, text).otherwise(plain)


def matches_terms(text: Column, query: str) -> Column:
    """Whether every word of the query occurs, ignoring case."""
    terms = [t for t in query.lower().split() if t]
    return reduce(lambda a, b: a & b, [F.contains(F.lower(text), F.lit(t)) for t in terms], F.lit(True))


def json_kind(value: Column) -> Column:
    """string, array, object, scalar (numbers, booleans) or null, of a variant; null of what isn't there."""

    def told(v: Column) -> Column:
        whole = lambda kind: F.try_variant_get(v, "$", kind).isNotNull()
        string = F.schema_of_variant(v) == "STRING"
        return F.when(v.isNull(), None).when(F.is_variant_null(v), "null").when(string, "string").when(whole("array<variant>"), "array").when(whole("map<string,variant>"), "object").otherwise("scalar")

    return F.get(F.transform(F.array(value), told), F.lit(0))  # so that the value is parsed once, not once for each question


def is_json_like(text: Column) -> Column:
    """Whether a text, without the spaces around it, is in braces or brackets."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return (bare.startswith("{") & bare.endswith("}")) | (bare.startswith("[") & bare.endswith("]"))


def is_tool_result_message(content: Column) -> Column:
    """Whether a content is a JSON array of tool results, at least one, and of nothing else."""
    items = F.from_json(content, "array<string>")
    own = F.forall(items, lambda x: x.startswith("{") & F.coalesce(F.get_json_object(x, "$.type") == "tool_result", F.lit(False)))
    return F.coalesce((F.size(items) > 0) & own, F.lit(False))


def message_anchor(timestamp: Column) -> Column:
    return F.when(F.coalesce(timestamp, F.lit("")) == "", "").otherwise(F.concat(F.lit("msg-"), F.translate(timestamp, ":.", "--")))


def project_display_name(folder: Column) -> Column:
    """The part of an encoded folder name that names the project."""
    lower = F.lower(folder)
    name = folder
    for prefix in reversed(fixed.PROJECT_PREFIXES):
        name = F.when(lower.startswith(prefix), F.substring(folder, len(prefix) + 1, F.length(folder))).otherwise(name)
    parts = F.split(name, "-")
    common = F.array(*[F.lit(x) for x in fixed.PROJECT_COMMON])
    user = F.arrays_overlap(F.transform(F.slice(parts, 2, F.size(parts)), F.lower), common) & (parts[0] != "")
    kept = F.filter(F.when(user, F.slice(parts, 2, F.size(parts))).otherwise(parts), lambda p: (p != "") & ~F.array_contains(common, F.lower(p)))
    fallback = F.coalesce(F.try_element_at(F.filter(parts, lambda p: p != ""), F.lit(-1)), folder)
    return F.when(F.size(kept) > 0, F.array_join(kept, "-")).otherwise(fallback)


def matches_project(folder: Column, wanted: str | None) -> Column:
    if not wanted:
        return F.lit(True)
    return F.contains(F.lower(project_display_name(folder)), F.lit(wanted.lower())) | F.contains(F.lower(folder), F.lit(wanted.lower()))


#: What a string may look like, in the order in which it is tried; an enum-like one has 30 characters at most.
STRING_FORMATS = [
    ("uuid", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    ("iso8601", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"),
    ("date", r"^\d{4}-\d{2}-\d{2}$"),
    ("boolean_string", r"^(?:true|false)\z"),
    ("url", r"^https?://"),
    ("email", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"),
    ("enum_like", r"^(?=[\s\S]{0,30}\z)[a-z_]+$"),
]


def string_format(value: Column) -> Column:
    """What a string looks like, without telling it; null for a plain one."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(STRING_FORMATS):
        out = F.when(value.rlike(pattern), name).otherwise(out)
    return out


def commits(text: Column) -> Column:
    """Array of struct hash, message of commit lines in a tool's output."""
    found = [F.regexp_extract_all(text, F.lit(fixed.COMMIT), F.lit(g)) for g in (1, 2)]
    return F.arrays_zip(found[0].alias("hash"), found[1].alias("message"))


def repository(text: Column) -> Column:
    got = F.regexp_extract(text, fixed.REPOSITORY, 1)
    return F.when(got != "", got)


def tool_stats(counts: Column) -> Column:
    """'3 bash . 1 read' from an array of struct (n, tool), the most used first."""
    ordered = F.array_sort(F.transform(counts, lambda c: F.struct((-c["n"]).alias("back"), c["tool"].alias("tool"))))
    return F.array_join(F.transform(ordered, lambda c: F.concat((-c["back"]).cast("string"), F.lit(" "), lookup(c["tool"], fixed.TOOL_SHORT_NAMES, F.lower(c["tool"])))), " . ")
