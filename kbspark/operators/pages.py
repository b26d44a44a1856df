"""Pages: bulk frontmatter parsing and rendering, replies, names, listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.text import as_list
from kbspark.session import configure

def _strip(text: Column) -> Column:
    """Without white space at both ends, by Unicode and the four separator controls."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def decode(content: Column) -> Column:
    """Bytes as text, invalid sequences replaced."""
    return F.make_valid_utf8(content.cast("string"))


def parse_pages(texts: DataFrame, id_col: str = "name", text_col: str = "text") -> DataFrame:
    """id, parsed_ok, keys (in order), fields map<key, scalar or list> and body of every page.

    A page opens with a line of three dashes and its frontmatter ends at the next such line.
    Blank lines are skipped; an item line ("  - x") belongs to the key before it, which must
    have an empty rest and only items between; any other line that starts blank, lacks a
    colon or has an empty key makes the page unparseable, as does a missing end. [a, b] is a
    list; a repeated key's last value wins. All in array expressions: no shuffle, no Python.
    """
    configure(texts.sparkSession)  # a map's repeated key: the last wins
    item = lambda x: x.startswith("  - ")
    head = lambda x: F.instr(x, ":") > 0
    entry = "struct<key:string,scalar:string,list:array<string>,open:boolean>"
    start = F.struct(F.array().cast(f"array<{entry}>").alias("done"), F.lit(False).alias("open"), F.lit(True).alias("ok"))

    def rest_of(x: Column) -> Column:
        return _strip(F.regexp_replace(x, "^[^:]*:", ""))

    def add(s: Column, x: Column) -> Column:
        done, is_open = s["done"], s["open"]
        key, rest = _strip(F.substring_index(x, ":", 1)), rest_of(x)
        inner = _strip(F.regexp_replace(F.regexp_replace(rest, r"^\[", ""), r"\]$", ""))
        inline = rest.startswith("[") & rest.endswith("]") & (F.length(rest) >= 2)
        items = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), lambda v: _strip(v)))
        fresh = F.struct(key.alias("key"), F.when(~inline, rest).alias("scalar"), F.when(inline, items).alias("list"), (rest == "").alias("open")).cast(entry)
        last = F.element_at(done, -1)
        grown = F.struct(last["key"].alias("key"), F.lit(None).cast("string").alias("scalar"), F.concat(F.coalesce(last["list"], F.array().cast("array<string>")), F.array(F.substring(x, 5, 1 << 30))).alias("list"), last["open"].alias("open")).cast(entry)
        more = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))
        good_head = head(x) & (key != "") & ~x.rlike("^[ \t]")
        state = lambda d, o, ok: F.struct(d.alias("done"), o.alias("open"), ok.alias("ok"))
        return (
            F.when(_strip(x) == "", state(done, F.lit(False), s["ok"]))
            .when(item(x) & is_open, state(more, F.lit(True), s["ok"]))
            .when(good_head, state(F.concat(done, F.array(fresh)), rest == "", s["ok"]))
            .otherwise(state(done, F.lit(False), F.lit(False)))
        )

    # Only the frontmatter is cut into lines; the body stays one piece of the text.
    pages = texts.select(F.col(id_col).alias("name"), F.col(text_col).alias("text"))
    close = F.locate("\n---\n", F.concat("text", F.lit("\n")), 4)  # of the newline before the end, from that of the first line on
    pages = pages.withColumn("end", F.when(F.concat("text", F.lit("\n")).startswith("---\n"), close).otherwise(0))
    block = F.when(F.col("end") > 4, F.split(F.substr("text", F.lit(5), F.col("end") - 5), "\n")).otherwise(F.array().cast("array<string>"))
    pages = pages.withColumn("read", F.aggregate(block, start, add))
    ok = (F.col("end") > 0) & F.col("read.ok")
    rest = F.substr("text", F.col("end") + 5)
    after = F.when(rest.startswith("\n"), F.substr(rest, F.lit(2))).otherwise(rest)
    pairs = F.transform("read.done", lambda e: F.struct(e["key"].alias("key"), F.struct(e["scalar"].alias("scalar"), e["list"].alias("list")).alias("value")))
    return pages.select(
        F.col("name").alias(id_col),
        F.coalesce(ok, F.lit(False)).alias("parsed_ok"),
        F.when(ok, F.array_distinct(F.transform("read.done", lambda e: e["key"]))).alias("keys"),
        F.when(ok, F.map_from_entries(pairs)).alias("fields"),
        F.when(ok, after).otherwise(F.col("text")).alias("body"),
    )


def scalar(name: str) -> Column:
    return F.coalesce(F.col("fields")[name]["scalar"], F.lit(""))


def listed(name: str) -> Column:
    return as_list(F.col("fields")[name]["scalar"], F.col("fields")[name]["list"])


def render(keys: Column, fields: Column, body: Column) -> Column:
    """Frontmatter in the order of keys, empty lists inline and others in block form, then the body."""

    def line(k: Column) -> Column:
        value = fields[k]
        block = F.concat(k, F.lit(":\n"), F.array_join(F.transform(value["list"], lambda v: F.concat(F.lit("  - "), v)), "\n"))
        return F.when(value["list"].isNull(), F.concat(k, F.lit(": "), F.coalesce(value["scalar"], F.lit("")))).when(F.size(value["list"]) == 0, F.concat(k, F.lit(": []"))).otherwise(block)

    return F.concat_ws("\n", F.lit("---"), F.array_join(F.transform(keys, line), "\n"), F.lit("---"), F.lit(""), body)


def unwrap_reply(reply: Column) -> Column:
    """A model's fenced reply as a page.

    Without a fence the stripped reply. After a fence, an opening of frontmatter is followed
    to its inner end: a fence right after that goes, else one on the last line; a fence
    without frontmatter becomes its dashes, but only with text after the closing fence.
    """
    text = F.btrim(reply, F.lit(" \t\r\n"))
    lines = F.split(text, "\n")
    n = F.size(lines)
    fence = lambda x: F.btrim(x, F.lit(" \t\r")).startswith("```")
    inner = F.slice(lines, 2, F.greatest(n - 1, F.lit(0)))
    deep = F.slice(lines, 3, F.greatest(n - 2, F.lit(0)))
    close = F.array_position(deep, "---")  # of the frontmatter, counted from the third line
    to = (close + 2).cast("int")  # its line
    after = F.slice(lines, to + 1, F.greatest(n - to, F.lit(0)))
    head = F.slice(lines, 2, F.greatest(to - 1, F.lit(0)))
    skip = fence(F.element_at(F.concat(after, F.array(F.lit(""))), 1))
    last = fence(F.element_at(lines, -1))
    framed = (
        F.when(close == 0, lines)
        .when(skip, F.concat(head, F.slice(after, 2, F.greatest(F.size(after) - 1, F.lit(0)))))
        .when(last & (F.size(after) > 0), F.concat(head, F.slice(after, 1, F.greatest(F.size(after) - 1, F.lit(0)))))
        .otherwise(lines)
    )
    at = F.array_position(F.transform(inner, lambda x: fence(x)), True).cast("int")  # the closing fence, in inner
    behind = F.slice(inner, at + 1, F.greatest(F.size(inner) - at, F.lit(0)))
    bare = F.when((at > 0) & (F.btrim(F.array_join(behind, "\n"), F.lit(" \t\r\n")) != ""), F.concat(F.array(F.lit("---")), F.slice(inner, 1, F.greatest(at - 1, F.lit(0))), F.array(F.lit("---")), behind)).otherwise(lines)
    is_page = F.element_at(F.concat(inner, F.array(F.lit(""))), 1) == "---"
    return F.when(~fence(lines[0]), text).when(is_page, F.array_join(framed, "\n")).otherwise(F.array_join(bare, "\n"))


def drop_reason() -> Column:
    """Why a parsed reply is dropped; null if it is not. Uses parse_pages() columns."""
    blank = lambda c: F.btrim(c, F.lit(" \t\r\n")) == ""
    ids = F.col("fields")["identifiers"]
    first = F.substring(F.split("body", "\n")[0], 1, 60)
    return (
        F.when(~F.col("parsed_ok"), F.concat(F.lit("unparseable: "), first))
        .when(blank(scalar("title")), F.lit("blank title"))
        .when(ids.isNull() | (ids["list"].isNull() & (ids["scalar"] != "")), F.lit("identifiers missing"))
        .when(F.exists(F.coalesce(ids["list"], F.array().cast("array<string>")), lambda x: blank(x)), F.lit("blank identifier"))
    )


def build_summary(cli_keys: Column, cli: Column, carried_keys: Column, carried: Column) -> tuple[Column, Column]:
    """(keys, fields): the job's own keys first, carried keys after; the job's values win."""
    keys = F.concat(cli_keys, F.array_except(carried_keys, cli_keys))
    return keys, F.map_concat(F.map_filter(carried, lambda k, v: ~F.array_contains(cli_keys, k)), cli)


def page_names(rows: DataFrame, taken: DataFrame, hash_chars: int, order: list[str]) -> DataFrame:
    """rows (slug, digest, ...) with `name`: the plain slug for its first holder, if no page has it yet."""
    first = Window.partitionBy("slug").orderBy(*order)
    out = rows.withColumn("nth", F.row_number().over(first)).join(taken.select(F.col("slug").alias("held")).distinct(), F.col("slug") == F.col("held"), "left")
    plain = (F.col("nth") == 1) & F.col("held").isNull()
    name = F.when(plain, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.substring("digest", 1, hash_chars)))
    return out.withColumn("name", F.concat(name, F.lit(".md"))).drop("nth", "held")


def list_page(pages: DataFrame, after: str | None = None, n: int | None = None, kind: str | None = None) -> DataFrame:
    """One listing: the first n names past `after`, then the kind filter; next_name if more follow."""
    if n is not None and n <= 0:
        raise ValueError("n must be positive")
    n = min(n or 200, 1000)
    found = pages.where(F.col("name") > after) if after is not None else pages
    found = found.orderBy("name").limit(n + 1)  # bounded by n
    w = Window.orderBy("name")
    found = found.withColumn("at", F.row_number().over(w)).withColumn("following", F.lead("name").over(w))
    last = F.max(F.when((F.col("at") == n) & F.col("following").isNotNull(), F.col("name"))).over(Window.partitionBy(F.lit(1)))
    found = found.withColumn("next_name", last).where(F.col("at") <= n)
    found = found.where(F.col("kind") == kind) if kind is not None else found
    return found.drop("at", "following")
