"""Column functions over titles, identifiers, urls and page text. All but two are built-in expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that identify a visit and not a document.
TRACKING = ["fbclid", "gclid", "ref"]
# Media type by file extension.
EXTENSIONS = {
    ".md": "text/markdown", ".txt": "text/plain", ".html": "text/html", ".htm": "text/html", ".json": "application/json",
    ".xml": "application/xml", ".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
}


def flatten_text(text: Column) -> Column:
    """Control characters, DEL, NEL and the Unicode line breaks become blanks, one for one."""
    return F.regexp_replace(text, r"[\x00-\x1f\x7f\x85  ]", " ")


def as_list(scalar: Column, items: Column) -> Column:
    """A list as it is, a non-empty scalar as one item, anything else as no items."""
    return F.when(items.isNotNull(), items).when(scalar != "", F.array(scalar)).otherwise(F.array().cast("array<string>"))


def is_ascii(text: Column) -> Column:
    return text.rlike(r"\A[\x00-\x7f]*+\z")


def _nfkd(text: Column) -> Column:
    """ASCII texts are their own decomposition; only others are sent to Python."""

    def each(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))

    return F.when(is_ascii(text), text).otherwise(F.pandas_udf(each, "string")(F.when(~is_ascii(text), text)))


def ascii_norm(value: Column) -> Column:
    """normalise_value() of ASCII text by built-in expressions."""
    return F.btrim(F.regexp_replace(F.lower(value), r"[\x09-\x0d\x1c-\x20]+", " "))


def normalise_value(value: Column) -> Column:
    """NFKC, case folded, stripped, white space runs as one blank.

    Unicode rules, hence no built-in; only texts that are not ASCII are sent to Python.
    """

    def each(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))

    return F.when(is_ascii(value), ascii_norm(value)).otherwise(F.pandas_udf(each, "string")(F.when(~is_ascii(value), value)))


def slugify(title: Column) -> Column:
    """NFKD, lower case, runs outside a-z0-9 as one dash, at most 120 characters; never empty."""
    dashed = F.btrim(F.regexp_replace(F.lower(_nfkd(title)), "[^a-z0-9]+", "-"), F.lit("-"))
    slug = F.btrim(F.substring(dashed, 1, 120), F.lit("-"))
    return F.when(slug != "", slug).otherwise(F.concat(F.lit("untitled-"), F.substring(F.sha1(title.cast("binary")), 1, 12)))


def key_of(identifier: Column) -> Column:
    return F.substring_index(identifier, ":", 1)


def value_of(identifier: Column) -> Column:
    """What follows the first colon; empty without one."""
    return F.when(F.instr(identifier, ":") > 0, F.regexp_replace(identifier, r"\A[^:]*:", "")).otherwise("")


def join_form(identifier: Column) -> Column:
    return F.struct(key_of(identifier).alias("key"), normalise_value(value_of(identifier)).alias("norm"))


def form_list(identifiers: Column) -> Column:
    """The distinct forms of a list of identifiers as texts, key and norm with a colon between, which no key has.

    Built where the row is, without a shuffle; only lists that are not all ASCII go to Python.
    """
    ids = F.filter(F.coalesce(identifiers, F.array().cast("array<string>")), lambda x: x.isNotNull())
    plain = F.forall(ids, lambda x: is_ascii(x))

    def each(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else [" ".join(unicodedata.normalize("NFKC", y).casefold().split()) for y in x])

    norms = F.when(plain, F.transform(ids, lambda x: ascii_norm(value_of(x)))).otherwise(F.pandas_udf(each, "array<string>")(F.when(~plain, F.transform(ids, lambda x: value_of(x)))))
    return F.array_distinct(F.zip_with(ids, norms, lambda x, n: F.concat(key_of(x), F.lit(":"), n)))


def media_type(content_type: Column, url: Column) -> Column:
    """The type before any parameter, else by the url's extension, else text/plain."""
    said = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^[a-z]+://[^/?#]*[^?#]*?(\.[a-z0-9]+)(?:[?#].*)?$", 1))
    by_extension = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[path]
    return F.when(said != "", said).otherwise(F.coalesce(by_extension, F.lit("text/plain")))


def is_url(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)^https?:"), F.lit(False))


def _decoded(part: Column) -> Column:
    """Percent-decoded, plus as blank; a percent sign that starts no escape stands for itself."""
    return F.url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def _recode(part: Column) -> Column:
    """Decode and encode again, blanks as plus; unlike url_encode, ~ stays and * does not."""
    return F.replace(F.replace(F.url_encode(_decoded(part)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def clean_url(url: Column) -> Column:
    """Without the fragment and the parameters that track visits; the query is encoded anew, blanks kept."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    keys = lambda p: F.lower(_decoded(F.substring_index(p, "=", 1)))
    kept = F.filter(pairs, lambda p: ~(keys(p).startswith("utm_") | keys(p).isin(TRACKING)))
    value = lambda p: F.when(F.instr(p, "=") > 0, F.regexp_replace(p, "^[^=]*=", "")).otherwise("")
    coded = F.array_join(F.transform(kept, lambda p: F.concat(_recode(F.substring_index(p, "=", 1)), F.lit("="), _recode(value(p)))), "&")
    return F.when(coded != "", F.concat(base, F.lit("?"), coded)).otherwise(base)


def model_slug(model: Column) -> Column:
    return F.replace(F.replace(model, F.lit("/"), F.lit("--")), F.lit(":"), F.lit("--"))


def embed_text(parsed_ok: Column, name: Column, title: Column, identifiers: Column, summary: Column, body: Column) -> Column:
    """What a page is embedded by: title, identifiers and summary, or the body's first 2000 characters."""
    lead = F.when(F.coalesce(summary, F.lit("")) != "", summary).otherwise(F.substring(body, 1, 2000))
    read = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.array_join(identifiers, "\n"), lead)
    return F.when(parsed_ok, read).otherwise(F.concat_ws("\n", name, F.substring(body, 1, 2000)))


def embed_hash(kind: Column, title: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\0", kind, title, text).cast("binary"), 256)


def prompt_fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n\n", *parts).cast("binary"), 256)


def wikilinks(body: Column) -> Column:
    """Targets of [[target]], [[target|label]] and [[target#part]], stripped, in order."""
    return F.transform(F.regexp_extract_all(body, F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), lambda x: F.trim(x))


def eval_text(title: Column, identifiers: Column, body: Column) -> Column:
    return F.substring(F.concat_ws("\n", title, F.array_join(identifiers, ", "), body), 1, 2000)


def candidate_stub(slug: Column, title: Column, body: Column) -> Column:
    return F.concat_ws(" | ", slug, title, F.substring(F.trim(F.replace(body, F.lit("\n"), F.lit(" "))), 1, 200))
