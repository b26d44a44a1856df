"""Quality checks over a page table: each gives findings (name, check, detail, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import text as t

CHECKS = ["frontmatter", "identifier-key", "identifier-value", "cites-summary", "dangling-source", "story-member", "duplicate-title"]


def _finding(df: DataFrame, check: str, detail: Column, seq: Column | None = None) -> DataFrame:
    return df.select("name", F.lit(check).alias("check"), detail.alias("detail"), (seq if seq is not None else F.lit(0)).cast("int").alias("seq"))


def fullmatch(value: Column, pattern: Column) -> Column:
    """The whole value matches; an empty value never does, nor one with a newline behind a match."""
    return (value != "") & F.rlike(value, F.concat(F.lit(r"\A(?:"), pattern, F.lit(r")\z")))


def _identifiers(pages: DataFrame) -> DataFrame:
    found = pages.where("parsed_ok").select("name", F.posexplode("identifiers").alias("pos", "identifier"))
    return found.withColumn("key", t.key_of(F.col("identifier"))).withColumn("value", t.value_of(F.col("identifier")))


def frontmatter(pages: DataFrame) -> DataFrame:
    return _finding(pages.where("not parsed_ok"), "frontmatter", F.lit("frontmatter does not parse"))


def identifier_key(pages: DataFrame, vocab: DataFrame) -> DataFrame:
    lost = _identifiers(pages).join(vocab.select("key"), "key", "left_anti")
    return _finding(lost, "identifier-key", F.concat(F.lit("undeclared key: "), "key"), F.col("pos"))


def identifier_value(pages: DataFrame, vocab: DataFrame) -> DataFrame:
    """Values empty or not matching; without a declared pattern only empty ones."""
    found = _identifiers(pages).join(vocab.select("key", "pattern"), "key")
    bad = (F.col("value") == "") | (F.col("pattern").isNotNull() & ~fullmatch(F.col("value"), F.col("pattern")))
    return _finding(found.where(bad), "identifier-value", F.concat(F.lit("bad value: "), "identifier"), F.col("pos"))


def agent_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("parsed_ok") & ~F.coalesce("kind", F.lit("")).isin("summary", "story"))


def cites_summary(pages: DataFrame) -> DataFrame:
    """Links of agent pages to a summary: by exact page stem, else by the slug group of a title.

    A stem that is a page of another kind settles the matter; each occurrence is a finding.
    """
    links = agent_pages(pages).select("name", F.posexplode(t.wikilinks(F.col("body"))).alias("pos", "target")).withColumn("target_slug", t.slugify(F.col("target")))
    stems = pages.where("parsed_ok").groupBy(F.col("stem").alias("target")).agg(F.max(F.col("kind") == "summary").alias("by_stem"))
    slugs = pages.where("parsed_ok and kind = 'summary'").select(t.slugify(F.col("title")).alias("target_slug"), F.lit(True).alias("by_slug")).distinct()
    found = links.join(stems, "target", "left").join(slugs, "target_slug", "left")
    hit = F.coalesce("by_stem", "by_slug", F.lit(False))
    return _finding(found.where(hit), "cites-summary", F.concat(F.lit("links a summary: "), "target"), F.col("pos"))


def dangling_source(pages: DataFrame, sources: DataFrame) -> DataFrame:
    lost = pages.where("parsed_ok and kind = 'summary'").join(sources.select(F.col("digest").alias("source")), "source", "left_anti")
    return _finding(lost, "dangling-source", F.concat(F.lit("no such source: "), "source"))


def story_member(pages: DataFrame) -> DataFrame:
    members = pages.where("parsed_ok and kind = 'story'").select("name", F.posexplode("members").alias("pos", "digest"))
    lost = members.join(pages.where("parsed_ok and kind = 'summary'").select(F.col("source").alias("digest")), "digest", "left_anti")
    return _finding(lost, "story-member", F.concat(F.lit("no summary of: "), "digest"), F.col("pos"))


def duplicate_title(pages: DataFrame, shown: int = 5) -> DataFrame:
    """Agent pages of one title slug; the other names sorted, the first few shown and the rest counted.

    Of a slug only shown + 1 names and a count are gathered, so a title that all pages share
    costs no more than any other.
    """
    own = agent_pages(pages).select("name", t.slugify(F.col("title")).alias("slug"))
    nth = F.row_number().over(Window.partitionBy("slug").orderBy("name"))
    first = own.withColumn("nth", nth).where(F.col("nth") <= shown + 1)
    first = first.groupBy("slug").agg(F.array_sort(F.collect_list("name")).alias("names"))
    counts = own.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1")
    found = own.join(counts.join(first, "slug"), "slug")
    others = F.slice(F.array_remove("names", F.col("name")), 1, shown)
    more = F.col("n") - 1 - F.size(others)
    detail = F.concat(F.lit("title shared with "), F.array_join(others, ", "), F.when(more > 0, F.concat(F.lit(" and "), more, F.lit(" more"))).otherwise(""))
    return _finding(found, "duplicate-title", detail)


def lint_all(pages: DataFrame, vocab: DataFrame, sources: DataFrame) -> DataFrame:
    """All findings with the check's place (check_order), for ordering by page, check and place in the page."""
    found = frontmatter(pages)
    for part in (identifier_key(pages, vocab), identifier_value(pages, vocab), cites_summary(pages), dangling_source(pages, sources), story_member(pages), duplicate_title(pages)):
        found = found.unionByName(part)
    order = F.array_position(F.array(*[F.lit(c) for c in CHECKS]), F.col("check")).cast("int")
    return found.withColumn("check_order", order)


def valid_answers(hits: DataFrame) -> DataFrame:
    """Hits (corpus, query, rank, name, title, size) of answers all of whose hits are well formed."""
    good = F.col("name").rlike(r"\A[^/\\\x00]+\.md\z") & F.col("title").isNotNull() & (F.coalesce("size", F.lit(-1)) >= 0)
    whole = F.min(F.coalesce(good, F.lit(False))).over(Window.partitionBy("corpus", "query"))
    return hits.withColumn("whole", whole).where("whole").drop("whole")
