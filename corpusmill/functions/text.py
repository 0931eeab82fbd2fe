"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common English words that TF-IDF leaves out unless it is given others.
STOP_WORDS = (
    "the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who boy did its let put say she too use "
    "this that with from have been they will would there their what about which when make like time just know take into your some could them than then look only come over think also back after work first well even want because these give most"
).split()
#: Words that keywords of a prompt leave out.
KEYWORD_STOPS = (
    "a an the and or but in on at to for of with by from up as is was are were be been being have has had do does did will would could should may might "
    "i we you he she they it this that these those what how when where why who which can need want let get make use just also so if then all not no yes"
).split()
#: MIME types by suffix.
MIME = {
    ".txt": "text/plain", ".md": "text/markdown", ".py": "text/x-python", ".html": "text/html", ".css": "text/css", ".csv": "text/csv", ".xml": "text/xml",
    ".js": "text/javascript", ".json": "application/json", ".pdf": "application/pdf", ".zip": "application/zip", ".png": "image/png", ".jpg": "image/jpeg", ".c": "text/x-c", ".sh": "application/x-sh",
}


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; a path without one is unchanged."""
    return F.regexp_replace(path, "/[^/]+$", "")


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; a leading dot starts no suffix."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"(?U)\s+"), ""))


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def clean(text: Column) -> Column:
    """White space to single spaces, other than words and .!?,;:-() dropped, lower case, trimmed."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"(?U)[^\w\s.!?,;:\-()]", "")))


def slug(text: Column) -> Column:
    cut = F.btrim(F.substring(F.regexp_replace(text, "[^a-zA-Z0-9_-]", "_"), 1, 40), F.lit("_"))
    return F.when(cut == "", "unknown").otherwise(cut)


def query_safe(text: Column) -> Column:
    """A search string without quotes and stars, nor operators at its ends."""
    return F.trim(F.btrim(F.trim(F.regexp_replace(text, "['\"*]", "")), F.lit("-+^():")))


def query_words(text: Column) -> Column:
    return F.array_remove(F.transform(F.split(text, r"\s+"), lambda x: F.btrim(x, F.lit(","))), "")


def strip_escapes(text: Column) -> Column:
    """Text without terminal escape sequences and control characters but tab, line feed and return."""
    out = F.regexp_replace(text, "\x1b\\][\\s\\S]*?(?:\x07|\x1b\\\\)", "")
    out = F.regexp_replace(out, "\x1b\\[[^A-Za-z]*[A-Za-z]", "")
    out = F.regexp_replace(out, "\x1b[\\s\\S]", "")
    return F.regexp_replace(out, "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), "[ \t]+", " ")


def short_hash(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))


def parse_time(text: Column) -> Column:
    """The first of three formats that fits, else null."""
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(x)) for x in formats])


def summary(text: Column, most: int = 200) -> Column:
    """Leading sentences, as long as they fit."""
    zero = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def step(acc: Column, s: Column) -> Column:
        longer = F.concat(acc["out"], F.trim(s), F.lit(". "))
        full = acc["full"] | (F.length(longer) > most)
        return F.struct(F.when(full, acc["out"]).otherwise(longer).alias("out"), full.alias("full"))

    return F.trim(F.aggregate(F.filter(F.split(text, r"\."), lambda s: F.trim(s) != ""), zero, step, lambda acc: acc["out"]))


def keywords(text: Column, most: int = 20) -> Column:
    """First words of three letters or more that aren't stop words, each once, lower-cased and without marks at their ends."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z_\-']{2,}"), F.lit(0))
    words = F.transform(words, lambda w: F.btrim(w, F.lit("'-_")))
    return F.slice(F.array_except(F.array_distinct(words), F.array(F.lit(""), *[F.lit(w) for w in KEYWORD_STOPS])), 1, most)


def mime_type(path_suffix: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), path_suffix)


def term_scores(terms: Column) -> Column:
    """A JSON array of [term, score] pairs or bare terms (score 1) as an array of (term, score); malformed text has none."""
    parsed = F.try_variant_get(F.try_parse_json(terms), "$", "array<variant>")
    one = lambda v: F.struct(F.coalesce(F.try_variant_get(v, "$[0]", "string"), F.try_variant_get(v, "$", "string")).alias("term"), F.coalesce(F.try_variant_get(v, "$[1]", "double"), F.lit(1.0)).alias("score"))
    return F.coalesce(F.transform(parsed, one), F.array().cast("array<struct<term:string,score:double>>"))


def cleaned_prompt(reply: Column) -> tuple[Column, Column]:
    """(text after CLEANED:, keywords after KEYWORDS:) of a reply; null and none where a line is missing."""
    after = lambda name: F.nullif(F.trim(F.regexp_extract(reply, rf"(?im)^{name}:[ \t]*(.*)$", 1)), F.lit(""))
    words = F.array_remove(F.transform(F.split(F.coalesce(after("KEYWORDS"), F.lit("")), ","), lambda w: F.lower(F.trim(w))), "")
    return after("CLEANED"), words


def shown_list(items: Column, most: int) -> Column:
    """The first items, joined by commas."""
    return F.array_join(F.slice(items, 1, most), ", ")


#: Detectors of the design notes, by kind.
DETECTORS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ipv4": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "secret": r"(?i)(?:api_?key|secret|token)\s*[=:]\s*\S+", "phone": r"\b[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}\b", "card": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b", "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "jwt": r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "mac": r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b", "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}\b",
}


def detected(text: Column) -> dict[str, Column]:
    return {kind: F.regexp_count(text, F.lit(p)) for kind, p in DETECTORS.items()}


def masked(text: Column) -> Column:
    """text with what the detectors find replaced by the kind's name, kinds in their order."""
    for kind, p in DETECTORS.items():
        text = F.regexp_replace(text, p, f"[{kind.upper()}]")
    return text


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits of any script: the plain tokenizer of search and postings."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
