"""Column functions on plain and LaTeX text. All are built from SQL expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "(?U)\\s"  # all Unicode white space, as the service's own patterns have it

# Limits of the service.
RESULT_CHARS = 60_000
TRUNCATION_MARK = "\n... [truncated]"
FILENAME_CHARS = 200
IMAGE_TYPES = ["image/png", "image/jpeg", "image/bmp", "image/tiff", "image/gif", "image/webp", "image/heic", "image/heif", "application/pdf"]
INPUT_EXTENSIONS = ["png", "jpg", "jpeg", "bmp", "gif", "webp", "tif", "tiff", "pdf"]

# Patterns of structure and mathematics.
STRUCTURE = {
    "section": r"\\section\b",
    "subsection": r"\\subsection\b",
    "itemize": r"\\begin\{itemize\}",
    "enumerate": r"\\begin\{enumerate\}",
    "item": r"\\item\b",
    "tabular": r"\\begin\{tabular\}",
    "display": r"\\\[|\\begin\{(?:equation|align|gather|multline)\*?\}",
    "frac": r"\\frac\b",
    "int": r"\\int\b",
    "sqrt": r"\\sqrt\b",
}
DISPLAYS = r"(?:equation\*?|align\*?|gather\*?|multline\*?)"
MATH = [r"\$\$([\s\S]+?)\$\$", r"\$([\s\S]+?)\$", r"\\\[([\s\S]+?)\\\]", rf"\\begin\{{{DISPLAYS}\}}([\s\S]+?)\\end\{{{DISPLAYS}\}}"]
MATH_BLOCK = r"\\\[|\\begin\{(?:equation\*?|align\*?|gather\*?|multline\*?|cases|[pbvV]?matrix)\}"
MATH_SIGNAL = r"[=<>^_+]|\\(?:int|sum|prod|frac|dfrac|sqrt|lim|partial|nabla|cdot|times|div|le|ge|neq|approx|equiv|pm|mp|to|rightarrow|infty|begin\{(?:cases|[pbvV]?matrix|align|array))"
MODEL_GONE = r"(?i)models/[\w.-]+ (?:is not found|was not found|not found)|is not supported for generateContent|is not supported for this method|NOT_FOUND|has been (?:retired|deprecated|discontinued)"
SAMPLING = r"(?i)\b(?:temperature|top_?p|top_?k)\b"


def or_default(col: Column, default: str) -> Column:
    """The default for null and for the empty string."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def truncate_mark(text: Column, most: int = RESULT_CHARS) -> Column:
    """At most so many characters, with a mark where some were cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(TRUNCATION_MARK))).otherwise(text)


def is_truncated(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit(TRUNCATION_MARK)), F.lit(False))


def filename_base(name: Column) -> Column:
    """The name without its last extension; `document` if nothing is left."""
    return or_default(F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[^.]*\z", ""), "document")


def filename_safe(name: Column) -> Column:
    return F.regexp_replace(F.substring(filename_base(name), 1, FILENAME_CHARS), r"[^\w.-]", "_")


def filename_cap(name: Column) -> Column:
    return F.substring(F.coalesce(name, F.lit("")), 1, FILENAME_CHARS)


def mime_safe(mime: Column) -> Column:
    """The bare media type if it is an allowed one, else image/png."""
    bare = F.lower(F.trim(F.split(F.coalesce(mime, F.lit("")), ";")[0]))
    return F.when(bare.isin(IMAGE_TYPES), bare).otherwise(F.lit("image/png"))


def input_allowed(name: Column) -> Column:
    """A known extension, or none at all."""
    name = F.coalesce(name, F.lit(""))
    return ~F.contains(name, F.lit(".")) | F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1)).isin(INPUT_EXTENSIONS)


def attempt_number(text: Column) -> Column:
    """A whole number from 0 up; what isn't a finite number is 0."""
    n = text.try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), 0).otherwise(F.greatest(F.lit(0), F.floor(n))).cast("bigint")


def valid_document_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.rlike(r"\A[A-Za-z0-9_-]{1,128}\z"), F.lit(False))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def is_prose(text: Column) -> Column:
    """Three or more runs of three or more letters."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]{3,}")) >= 3


def looks_like_equation(latex: Column) -> Column:
    return F.coalesce((F.trim(latex) != "") & latex.rlike(MATH_SIGNAL), F.lit(False))


def distinct_ratio(text: Column) -> Column:
    w = words(text)
    return F.size(F.array_distinct(w)) / F.nullif(F.size(w), F.lit(0))


def looks_like_loop(text: Column) -> Column:
    """Six words or more, a quarter of them distinct at most."""
    return (F.size(words(text)) >= 6) & (F.coalesce(distinct_ratio(text), F.lit(1.0)) <= 0.25)


def normalised(latex: Column) -> Column:
    """A formula as it is compared: outer dollars, spacing commands and braces round single characters removed."""
    t = F.regexp_replace(F.coalesce(latex, F.lit("")), r"(?U)\A\s+|\s+\z", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\A\$+|\$+\z", ""), r"(?U)\A\s+|\s+\z", "")
    for pattern, to in (
        (r"\\dfrac|\\tfrac", r"\\frac"),
        (r"\\left|\\right|\\quad|\\qquad|\\,|\;|\\!|\\:", " "),
        (r"(?U)\\operatorname\s*\{([^}]*)\}", r"\\$1"),
        (r"(?U)\{\s*([A-Za-z0-9])\s*\}", "$1"),
        (r"(?U)\s+", ""),
    ):
        t = F.regexp_replace(t, pattern, to)
    return t


def tokens(latex: Column) -> Column:
    """Control words, and single characters."""
    return F.regexp_extract_all(F.coalesce(latex, F.lit("")), F.lit(r"(?s)\\[A-Za-z]+|."), F.lit(0))


def body_of(tex: Column) -> Column:
    """What stands inside the document environment, or all of it."""
    tex = F.coalesce(tex, F.lit(""))
    pattern = r"\\begin\{document\}([\s\S]*?)\\end\{document\}"
    return F.when(tex.rlike(pattern), F.regexp_extract(tex, pattern, 1)).otherwise(tex)


def plain_text(tex: Column) -> Column:
    """The prose of a document in lower case, without markup and mathematics."""
    t = body_of(tex)
    for pattern in (r"\\begin\{[\s\S]*?\}|\\end\{[\s\S]*?\}", *MATH, r"\\[a-zA-Z@]+\*?", r"[{}$&\\~^_#]", r"%[^\n\r\x{2028}\x{2029}]*"):
        t = F.regexp_replace(t, pattern, " ")
    return F.lower(F.array_join(words(t), " "))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


def text_score(truth: Column, guess: Column) -> Column:
    """1 - edits / characters of the prose, 0 at least; null where the truth has no prose."""
    a, b = plain_text(truth), plain_text(guess)
    return F.when(F.length(a) > 0, F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / F.length(a)))


def structure_score(truth: Column, guess: Column) -> Column:
    """Share of the truth's structural elements that the guess has too; null where there are none."""
    a, b = body_of(truth), body_of(guess)
    pairs = [(count_matches(a, p), count_matches(b, p)) for p in STRUCTURE.values()]
    total, hit = sum((x for x, _ in pairs[1:]), pairs[0][0]), sum((F.least(x, y) for x, y in pairs[1:]), F.least(*pairs[0]))
    return F.when(total > 0, hit / total)


def math_expressions(tex: Column) -> Column:
    """All expressions, normalised, of each kind of delimiter one after another; what two kinds match counts twice."""
    body = body_of(tex)
    found = F.concat(*(F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in MATH))
    return F.filter(F.transform(found, normalised), lambda x: x != "")


def text_blocks(tex: Column) -> Column:
    """Paragraphs between blank lines."""
    pattern = r"\\begin\{document\}([\s\S]*)\\end\{document\}"
    tex = F.coalesce(tex, F.lit(""))
    body = F.when(tex.rlike(pattern), F.regexp_extract(tex, pattern, 1)).otherwise(tex)
    return F.size(F.filter(F.split(body, r"(?U)\n\s*\n"), lambda b: F.regexp_replace(b, SPACE, "") != ""))


def equation_blocks(tex: Column) -> Column:
    return count_matches(body_of(tex), MATH_BLOCK)


def summarised(tex: Column, pages: Column | int = 1) -> Column:
    """A struct that describes a document: pages, textBlocks, equations, and no uncertain lines."""
    pages = F.lit(pages) if isinstance(pages, int) else pages
    return F.struct(F.coalesce(pages, F.lit(1)).cast("bigint").alias("pages"), text_blocks(tex).alias("textBlocks"), equation_blocks(tex).alias("equations"), F.lit(0).alias("uncertainLines"))


def fenced_latex(reply: Column) -> Column:
    """The last fenced block that is a document, else the last block, else a bare document, else null."""
    blocks = F.regexp_extract_all(reply, F.lit(r"(?U)```(?:latex|tex)?\s*\n([\s\S]*?)```"), F.lit(1))
    whole = F.filter(blocks, lambda b: F.contains(b, F.lit("\\documentclass")) | F.contains(b, F.lit("\\begin{document}")))
    bare = F.nullif(F.regexp_extract(reply, r"(\\documentclass[\s\S]*?\\end\{document\})", 1), F.lit(""))
    best = F.when(F.size(whole) > 0, F.element_at(whole, -1)).when(F.size(blocks) > 0, F.element_at(blocks, -1)).otherwise(bare)
    return F.regexp_replace(best, r"(?U)\A\s+|\s+\z", "")


def reply_text(json: Column) -> Column:
    """The text of all parts of a model reply's first candidate."""
    kind = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>>"
    parts = F.get(F.from_json(json, kind).getField("candidates"), F.lit(0)).getField("content").getField("parts")
    return F.array_join(F.transform(F.coalesce(parts, F.array().cast("array<struct<text:string>>")), lambda p: F.coalesce(p.getField("text"), F.lit(""))), "")


def retry_seconds(json: Column) -> Column:
    """Seconds of the first RetryInfo detail; 0 without one."""
    kind = "struct<error:struct<details:array<struct<`@type`:string,retryDelay:string>>>>"
    info = F.filter(F.from_json(json, kind).getField("error").getField("details"), lambda d: F.contains(d.getField("@type"), F.lit("RetryInfo")))
    return F.coalesce(F.nullif(F.regexp_extract(F.get(info, F.lit(0)).getField("retryDelay"), r"\A\s*(\d+)", 1), F.lit("")).cast("bigint"), F.lit(0))


def model_is_gone(status: Column, text: Column) -> Column:
    return (status == 404) | (status.isin(400, 403) & F.coalesce(text.rlike(MODEL_GONE), F.lit(False)))


def sampling_refused(status: Column, text: Column) -> Column:
    return (status == 400) & F.coalesce(text.rlike(SAMPLING), F.lit(False))


def missing_packages(log: Column) -> Column:
    """Names of packages that the log doesn't find, sorted."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(F.coalesce(log, F.lit("")), F.lit(r"File [`']([^'`]+)\.sty' not found"), F.lit(1))))


def files_for(tex: Column) -> Column:
    """The class file and package files that a source asks for, comments left out."""
    source = F.regexp_replace(F.coalesce(tex, F.lit("")), r"(?m)(^|[^\\])%.*$", "$1")
    cls = F.regexp_extract(source, r"\\documentclass\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}", 1)
    lists = F.regexp_extract_all(source, F.lit(r"\\usepackage\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}"), F.lit(1))
    names = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda x: F.trim(x))
    keys = F.concat(F.when(cls != "", F.array(F.concat(F.lit("26/"), F.trim(cls), F.lit(".cls")))).otherwise(F.array().cast("array<string>")), F.transform(names, lambda n: F.concat(F.lit("26/"), n, F.lit(".sty"))))
    return F.filter(F.array_distinct(keys), lambda k: k.rlike(r"\A26/[A-Za-z0-9._-]+\.(?:cls|sty)\z"))


def heading_level(text: Column) -> Column:
    """subsection if it is numbered with a dot, else section."""
    number = F.regexp_extract(F.trim(text), r"(?U)\A\d+(\.\d+)*\s", 0)
    return F.when(F.contains(number, F.lit(".")), F.lit("subsection")).otherwise(F.lit("section"))
