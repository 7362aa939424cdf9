"""Column functions on text, paths, URLs, lists and typed values. All stay in the JVM."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s"  # Unicode white space, as request trimming has it


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def blank(c: Column) -> Column:
    """Whether nothing is left after trimming; null is blank."""
    return F.coalesce(trimmed(c) == "", F.lit(True))


def preview(c: Column, limit: int = 1200) -> Column:
    """White space runs as one space, cut at the limit with three dots."""
    compact = trimmed(F.regexp_replace(c, rf"{SPACE}+", " "))
    return F.when(F.length(compact) > limit, F.concat(F.substring(compact, 1, limit), F.lit("..."))).otherwise(compact)


def is_cwe(c: Column) -> Column:
    """A weakness id; ``\\z`` because ``$`` would let a line end pass."""
    return c.rlike(r"\ACWE-[0-9]+\z")


def is_sha256(c: Column) -> Column:
    """64 lower-case hexadecimal digits."""
    return c.rlike(r"\A[0-9a-f]{64}\z")


def is_git_url(c: Column) -> Column:
    """``user@host:path``, or an https or ssh URL with host and path, no password, and on https no user."""
    scp = c.rlike(r"\A[^@\s]+@[^:\s]+:.+\z")

    def part(name: str) -> Column:
        return F.try_parse_url(c, F.lit(name))

    scheme, user = F.lower(part("PROTOCOL")), part("USERINFO")
    url = scheme.isin("https", "ssh") & part("HOST").isNotNull() & (F.coalesce(part("PATH"), F.lit("")) != "")
    url = url & ~F.coalesce(user.contains(":"), F.lit(False)) & ~((scheme == "https") & user.isNotNull())
    return F.coalesce(scp | url, F.lit(False))


def source_error(source_type: Column, remote_url: Column, credential_ref: Column, default_branch: Column) -> Column:
    """What is wrong with a repository's source fields; null if nothing."""
    git = source_type == "git"
    return (
        F.when(git & remote_url.isNull(), "remote_url required")
        .when(git & ~is_git_url(remote_url), "remote_url must use HTTPS or SSH")
        .when(~git & remote_url.isNotNull(), "remote_url not allowed")
        .when(~git & credential_ref.isNotNull(), "credential_ref not allowed")
        .when(~git & default_branch.isNotNull(), "default_branch not allowed")
    )


def relative_path(c: Column) -> Column:
    """The path with forward slashes; null if it is absolute, has ``..``, or a drive prefix."""
    path = F.replace(c, F.lit("\\"), F.lit("/"))
    bad = path.startswith("/") | F.array_contains(F.split(path, "/"), "..") | (F.substring(path, 2, 1) == ":")
    return F.when(~bad, path)


def is_absolute_path(c: Column) -> Column:
    """Absolute, with at least one part, and no ``..``."""
    parts = F.filter(F.split(c, "/"), lambda p: ~p.isin("", "."))
    return c.startswith("/") & (F.size(parts) > 0) & ~F.array_contains(parts, "..") & ~c.rlike(r"/\.?\z")


def filled(template: Column, values: dict[str, Column]) -> Column:
    """The template with ``{key}`` replaced, key after key: a later key also replaces within values put in before."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{" + key + "}"), value)
    return template


def missing_placeholders(template: Column, keys: list[str]) -> Column:
    """The keys whose placeholder the template lacks."""
    return F.filter(F.array(*map(F.lit, keys)), lambda k: ~F.contains(template, F.concat(F.lit("{"), k, F.lit("}"))))


def has_repeats(a: Column) -> Column:
    """Whether an array holds a value twice."""
    return F.size(a) != F.size(F.array_distinct(a))


def unsupported(a: Column, known: list[str]) -> Column:
    """Values that are not known, in order."""
    return F.array_sort(F.array_except(a, F.array(*map(F.lit, known))))


def has_exact_keys(json: Column, keys: list[str]) -> Column:
    """Whether a JSON object has these keys and no others."""
    return F.coalesce(F.array_sort(F.json_object_keys(json)) == F.array(*map(F.lit, sorted(keys))), F.lit(False))


def extra_keys(json: Column, keys: list[str]) -> Column:
    """Keys of a JSON object beyond these, in order."""
    return F.array_sort(F.array_except(F.json_object_keys(json), F.array(*map(F.lit, keys))))


def merged(left: Column, right: Column) -> Column:
    """Two maps as one; the right one wins."""
    return F.map_zip_with(left, right, lambda k, a, b: F.when(F.array_contains(F.map_keys(right), k), b).otherwise(a))


def missing_values(env: Column, required: list[str]) -> Column:
    """Required keys that a map lacks or has empty."""
    return F.filter(F.array(*map(F.lit, required)), lambda k: F.coalesce(F.element_at(env, k) == "", F.lit(True)))


def positive_int(c: Column) -> Column:
    """The text as an int over 0, else null."""
    n = c.try_cast("int")
    return F.when(n > 0, n)


def seconds(c: Column) -> Column:
    """The text as seconds from 0, else null."""
    n = c.try_cast("double")
    return F.when((n >= 0) & ~F.isnan(n), n)


def probability(c: Column) -> Column:
    """The text as a decimal from 0 to 1, else null; decimals, so that shares can add up to exactly 1."""
    n = c.try_cast("decimal(38,18)")
    return F.when(n.between(0, 1), n)


def timed_out(cancelled: Column, flag: Column, code: Column) -> Column:
    """Not cancelled, and over time by its flag or its exit code."""
    return ~cancelled & (flag | F.coalesce(code.isin(124, 137), F.lit(False)))


def http_ok(status: Column) -> Column:
    """A status from 200 to 299; null (no answer) is not ok."""
    return F.coalesce(status.between(200, 299), F.lit(False))


def first_rule(rules: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first rule that holds."""
    out = None
    for condition, value in rules:
        out = F.when(condition, F.lit(value)) if out is None else out.when(condition, F.lit(value))
    return out.otherwise(F.lit(otherwise)) if out is not None else F.lit(otherwise)


def fingerprint(*parts: Column, separator: str = "\x1f") -> Column:
    """SHA-256 over the parts; nulls count as empty so that no part shifts into another's place."""
    return F.sha2(F.concat_ws(separator, *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def assistant_text(content: Column, stdout: Column) -> Column:
    """The text parts of a message (array of struct type, text) by line ends, or the raw output where there are none."""
    texts = F.transform(F.filter(content, lambda p: (p["type"] == "text") & (p["text"] != "")), lambda p: p["text"])
    joined = trimmed(F.array_join(texts, "\n"))
    return F.when(joined != "", joined).otherwise(stdout)


@cache
def _foldings() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one other, what they fold to, and those that fold to several, by Python's Unicode tables."""
    folded = {c: c.casefold() for c in map(chr, range(0x20000)) if not "\ud800" <= c <= "\udfff"}
    one = {c: f for c, f in folded.items() if f != c and len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in folded.items() if len(f) > 1}


def case_folded(c: Column) -> Column:
    """Full case folding as ``str.casefold`` has it: sharp s is ss, a final sigma a sigma, dotted I an i and a dot. Null stays null."""
    one, to, several = _foldings()
    single = F.translate(c, one, to)
    spread = reduce(lambda x, m: F.replace(x, F.lit(m[0]), F.lit(m[1])), several.items(), single)
    return F.when(single.rlike(f"[{''.join(several)}]"), spread).otherwise(single)
