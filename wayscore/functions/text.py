"""String, JSON and array expressions over run logs and source texts; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line breaks: \r\n counts once; then LF, CR, VT, FF, FS, GS, RS, NEL, LS, PS.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
# Fixed values of the log format: tags of code fences, headings of file sections, weakness numbers, addresses of commits.
FENCE_TAGS = ("json", "python", "java")
HEADING = r"(?d)===== (.*?) ====="
WEAKNESS = r"(?i)cwe[\s\-_]*?(\d+)"
COMMIT = r"^(https://github\.com/[^/]+/[^/]+)/commit/"


def strip(c: Column) -> Column:
    """Removes all leading and trailing white space, not blanks alone."""
    return F.regexp_replace(c, r"^[\s\x1C-\x1F\x{85}\x{A0}]+|[\s\x1C-\x1F\x{85}\x{A0}]+$", "")


def or_default(c: Column, default: str) -> Column:
    """Stripped text, or ``default`` where it is null or blank."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(default))


def fenced(c: Column) -> Column:
    """The body of the first fenced block; without a closed fence, the text less its fence marks."""
    tags = "|".join(FENCE_TAGS)
    text = strip(c)
    pattern = rf"(?s)```(?:{tags})?\s*(.*?)\s*```"
    loose = text
    for tag in FENCE_TAGS:
        loose = F.replace(loose, F.lit(f"```{tag}"), F.lit(""))
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1))).otherwise(strip(F.replace(loose, F.lit("```"), F.lit(""))))


def case_id(*candidates: Column) -> Column:
    """First candidate that isn't null, cut at the first underscore and then at the first colon."""
    return strip(F.split_part(F.split_part(F.coalesce(*candidates), F.lit("_"), F.lit(1)), F.lit(":"), F.lit(1)))


def needed_files(given: Column, prompt_input: Column) -> Column:
    """The given list, or the names in ``===== name =====`` headings on one line, in order and with repeats."""
    named = F.transform(F.regexp_extract_all(F.coalesce(prompt_input, F.lit("")), F.lit(HEADING), F.lit(1)), strip)
    return F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).otherwise(named)


def line_range(c: Column) -> tuple[Column, Column]:
    """Start and end of ``a-b``: the first two fields between hyphens; null where either isn't a number."""
    parts = F.split(c, "-")
    first, last = (F.get(parts, F.lit(i)).try_cast("int") for i in (0, 1))
    whole = first.isNotNull() & last.isNotNull()
    return F.when(whole, first), F.when(whole, last)


def lines_of(c: Column) -> Column:
    """Lines of a text; a break at the end opens no further line, and an empty text has none."""
    cut = F.split(F.regexp_replace(c, f"(?:{LINE_BREAK})$", ""), LINE_BREAK)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(cut)


def line_count(c: Column) -> Column:
    return F.size(lines_of(F.coalesce(c, F.lit(""))))


def numbered(c: Column) -> Column:
    """Each line with ``L<n>: `` before it, from one."""
    return F.array_join(F.transform(lines_of(c), lambda x, i: F.concat(F.lit("L"), (i + 1).cast("string"), F.lit(": "), x)), "\n")


def headed(name: Column, text: Column) -> Column:
    """A file's section of a prompt: its heading, then its numbered lines."""
    return F.concat(F.lit("===== "), name, F.lit(" =====\n"), numbered(text))


def cwe_numbers(c: Column) -> Column:
    """Distinct numbers of all ``CWE-<n>`` mentions in an array of texts, in order; numbers beyond an int are none."""
    joined = F.concat_ws(" ", c)
    return F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(joined, F.lit(WEAKNESS), F.lit(1)), lambda x: x.try_cast("int"))))


#: A text, a number, or a brace of JSON.
JSON_TOKEN = r'"(?:[^"\\]|\\.)*+"|-?\d++(?:\.\d++)?(?:[eE][+-]?\d++)?|[{}]'


def cwe_values(raw: Column) -> Column:
    """Distinct weakness numbers of a JSON value of any shape, in order.

    Whole numbers by themselves or in lists, however nested, are weaknesses; of
    texts, those that they mention.  In an object only texts count.  Null, and
    what isn't JSON, gives none.
    """
    tokens = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(JSON_TOKEN), F.lit(0))
    none = F.array().cast("array<int>")
    state = F.struct(F.lit(0).alias("deep"), none.alias("found"))

    def step(s, t):
        text = F.get_json_object(F.concat(F.lit("["), t, F.lit("]")), "$[0]")
        told = F.when(t.startswith('"'), cwe_numbers(F.array(text))).when((s["deep"] == 0) & t.rlike(r"^-?\d+$"), F.array_compact(F.array(t.try_cast("int")))).otherwise(none)
        return F.struct((s["deep"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)).alias("deep"), F.concat(s["found"], told).alias("found"))

    return F.array_distinct(F.aggregate(tokens, state, step, lambda s: s["found"]))


def prompt_name(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.when(low == "llmpath", "LLMPath").when(low == "baseline", "Baseline").otherwise(strip(c))


def log_name(parts: list[Column], at: Column) -> Column:
    """File name of a run log: slashes doubled to underscores, a timestamp at the end."""
    safe = [F.replace(p, F.lit("/"), F.lit("__")) for p in parts]
    return F.concat(F.concat_ws("_", *safe, F.date_format(at, "yyyyMMdd_HHmmss")), F.lit(".json"))


def project_url(project: Column, commit_url: Column) -> Column:
    """``owner/repo`` as a repository address; otherwise the repository of a GitHub commit address, else null."""
    own = F.regexp_extract(F.coalesce(commit_url, F.lit("")), COMMIT, 1)
    return F.when(project.contains("/"), F.concat(F.lit("https://github.com/"), project)).otherwise(F.nullif(own, F.lit("")))


def line_list(raw: Column) -> Column:
    """The lines of a raw JSON value: a list as it is, a number or text as a list of one; null and empty text as none."""
    none = F.array().cast("array<string>")
    listed = F.coalesce(F.from_json(raw, "array<string>"), none)
    return F.when(F.coalesce(raw, F.lit("")) == "", none).when(F.ltrim(raw).startswith("["), listed).otherwise(F.array(raw))


def output_label(findings: Column, has_findings: Column, lines_map: Column) -> Column:
    """1 where any finding, or any file with lines, was reported."""
    listed = F.coalesce(F.size(findings), F.lit(0)) > 0
    lines = F.exists(F.coalesce(F.map_values(lines_map), F.array().cast("array<array<string>>")), lambda x: F.coalesce(F.size(x), F.lit(0)) > 0)
    return F.when(has_findings, listed.cast("int")).otherwise(F.coalesce(lines, F.lit(False)).cast("int"))
