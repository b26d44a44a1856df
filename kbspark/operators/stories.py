"""Stories: summaries grouped by shared identifiers in arrival order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import text as t
from kbspark.operators.components import components
from kbspark.operators.forms import Deals, by_class, expanded, forms, shared
from kbspark.session import materialise


def candidate_pairs(summary_forms: DataFrame, story_forms: DataFrame, extra: DataFrame | None = None, dealt: bool = False, deals: Deals | None = None) -> DataFrame:
    """(digest, story, shared): stories that share a form with a summary, or that `extra` names.

    summary_forms (digest, key, norm) and story_forms (story, key, norm) come from forms() or a stored index.
    Without extra, dealt keeps the deals of the pairs, in which ranked() ranks them where they are.
    """
    found = shared(summary_forms, story_forms, dealt=dealt and extra is None, deals=deals)
    if extra is None:
        return found
    return extra.select("digest", "story").distinct().join(found, ["digest", "story"], "full_outer").select("digest", "story", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"))


def ordered_candidates(pairs: DataFrame, stories: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """pairs with `place`: most shared first, then vector rank, then earliest story, then name."""
    out = pairs.join(stories.select("story", "first_seen"), "story", "left")
    order = [F.desc("shared")]
    if extra is not None:
        out = out.join(extra.select("digest", "story", "vector_rank"), ["digest", "story"], "left")
        order.append(F.asc_nulls_last("vector_rank"))
    order += [F.coalesce("first_seen", F.lit("")), F.col("story")]
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*[c for c in ("deal", "digest") if c in pairs.columns]).orderBy(*order)))


def told(story_forms: DataFrame, stories: DataFrame) -> DataFrame:
    """story_forms whose `story` is a struct (first_seen, story, what else `stories` (story, first_seen, ...) tells of it).

    What ranks and names a story goes to the pairs with it: they are joined with nothing by story,
    however many stories there are, and the struct's order is that of ranks.
    """
    row = F.struct(F.coalesce("first_seen", F.lit("")).alias("first_seen"), "story", *[c for c in stories.columns if c not in ("first_seen", "story")])
    return story_forms.join(stories, "story", "left").select(row.alias("story"), "key", "norm")


def ranked(pairs: DataFrame) -> DataFrame:
    """(digest, shared, place, first_seen, story, ...) of dealt pairs of told() forms, in the order of ordered_candidates()."""
    place = F.row_number().over(Window.partitionBy("deal", "digest").orderBy(F.desc("shared"), "story"))
    return pairs.withColumn("place", place).select("digest", "shared", "place", "story.*")


def candidate_lists(pairs: DataFrame) -> DataFrame:
    """(deal, digest, found) of dealt pairs of told() forms: each digest's stories in order, one list a row."""
    found = F.sort_array(F.collect_list(F.struct((-F.col("shared")).alias("less"), "story"))).alias("found")
    return pairs.groupBy("deal", "digest").agg(found).select("deal", "digest", F.col("found.story").alias("found"))


def blocks(summaries: DataFrame, by_slug: bool = True, near: DataFrame | None = None) -> DataFrame:
    """(digest, component) of summaries (digest, identifiers, slug): those that can influence one another.

    Edges join a digest to its forms, to what `near` (digest, other) names and, as names settle
    ties, to its slug.
    """
    node = lambda tag, *c: F.concat_ws("\x01", F.lit(tag), *c)
    edges = forms(summaries, "digest").select(node("d", "digest").alias("a"), node("f", "key", "norm").alias("b"))
    if by_slug:
        edges = edges.unionByName(summaries.select(node("d", "digest").alias("a"), node("s", "slug").alias("b")))
    if near is not None:
        edges = edges.unionByName(near.select(node("d", "digest").alias("a"), node("d", "other").alias("b")))
    found = components(edges).where(F.col("node").startswith("d\x01"))
    found = found.select(F.substring("node", 3, 1 << 20).alias("digest"), "component")
    found = found.join(summaries.select("digest").distinct(), "digest", "left_semi") if near is not None else found
    alone = summaries.select("digest").join(found, "digest", "left_anti").withColumn("component", node("d", "digest"))
    return found.unionByName(alone)


class Page(NamedTuple):
    """A summary as the judge sees it."""

    digest: str
    title: str
    text: str


class Story(NamedTuple):
    """A candidate as the judge sees it: the texts are those of its members so far."""

    name: str
    title: str
    texts: list[str]


Judge = Callable[[Page, list[Story]], str | None]


def first_candidate(page: Page, candidates: list[Story]) -> str | None:
    return candidates[0].name if candidates else None


def chosen(judge: Judge, page: Page, candidates: list[Story]) -> str | None:
    """What the judge answers, if it names a candidate; nothing else is a join."""
    name = judge(page, candidates) if candidates else None
    return name if any(name == c.name for c in candidates) else None


def judged(rows: DataFrame, judge: Judge) -> DataFrame:
    """(digest, story) of rows (digest, title, body, names, titles): which of a summary's candidates, named in order, the judge takes."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = zip(*[batch.column(c).to_pylist() for c in ("digest", "title", "body", "names", "titles")])
            found = [chosen(judge, Page(digest, title, body), [Story(n, t, []) for n, t in zip(names, titles)]) for digest, title, body, names, titles in asked]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(found, pa.string())], ["digest", "story"])

    return rows.mapInArrow(ask, "digest string, story string")


class _Shelf:
    """The stories of one component while its summaries come in."""

    def __init__(self) -> None:
        self.first: dict[str, str] = {}
        self.title: dict[str, str] = {}
        self.texts: dict[str, list[str]] = {}
        self.holding: dict[str, set[str]] = {}
        self.best: dict[str, tuple[str, str]] = {}
        self.seeded: dict[str, list[str]] = {}
        self.home: dict[str, str] = {}
        self.seq = 0

    def admit(self, name: str, row: dict) -> None:
        """A row in its story. Only stories that were there before can get an earlier first time, as rows come by time."""
        was = self.first.get(name)
        first = self.first[name] = row["fetched"] if was is None else min(was, row["fetched"])
        if row["story"]:
            self.seeded.setdefault(name, [])
        if name in self.seeded:
            self.seeded[name] += row["forms"]
        for f in row["forms"]:
            self.holding.setdefault(f, set()).add(name)
        for f in row["forms"] if was is None or first == was else self.seeded.get(name, row["forms"]):
            self.best[f] = min(self.best.get(f, (first, name)), (first, name))
        if "body" in row:
            if was is None:
                self.title[name], self.texts[name] = row["title"], []
            if row["body"]:
                self.texts[name].append(row["body"])
            self.home[row["digest"]] = name

    def candidates(self, row: dict) -> list[str]:
        shared: Counter = Counter(name for f in row["forms"] for name in self.holding.get(f, ()))
        near: dict[str, int] = {}
        for x in sorted(row["near"], key=lambda x: x["rank"]):
            if (name := self.home.get(x["other"])) is not None:
                near.setdefault(name, len(near))
        return sorted({*shared, *near}, key=lambda n: (-shared[n], near.get(n, len(near)), self.first[n], n))

    def leading(self, row: dict) -> str | None:
        """The first of candidates() without `near`, found without a list of them.

        A story that shares two forms is in the set of another than the form that most stories
        hold; if none does, the best of a form's stories is known.
        """
        forms = sorted((f for f in row["forms"] if f in self.holding), key=lambda f: len(self.holding[f]))
        if not forms:
            return None
        held = [self.holding[f] for f in forms]
        if len(held) == 2:
            top = held[0] & held[1]
        else:
            shared: Counter = Counter()
            for names in held[:-1]:
                shared.update(names)
            shared.update(held[-1] & shared.keys())
            most = max(shared.values(), default=0)
            top = [n for n, c in shared.items() if c == most] if most > 1 else ()
        return min((self.first[n], n) for n in top)[1] if top else min(self.best[f] for f in forms)[1]

    def place(self, row: dict, judge: Judge | None) -> tuple[str, str, str, int]:
        if judge is None:
            name = self.leading(row)
        else:
            found = [Story(n, self.title[n], self.texts[n]) for n in self.candidates(row)]
            name = chosen(judge, Page(row["digest"], row["title"], row["body"]), found)
        action = "joined" if name else "started"
        if not name:
            name = row["slug"] if row["slug"] not in self.first else f"{row['slug']}-{row['digest'][:8]}"
        self.admit(name, row)
        self.seq += 1
        return row["digest"], name, action, self.seq - 1


PLACED = "digest string, story string, action string, seq int"
# Edges between numbers, 16 bytes each, that one task contracts at a time.
PLACE_EDGES = 1 << 21


def _fold(judge: Judge | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by component, existing stories first, then (fetched, digest)."""
        component, shelf = None, _Shelf()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["component"] != component:
                    component, shelf = row["component"], _Shelf()
                if row["story"]:
                    shelf.admit(row["story"], row)
                else:
                    out.append(shelf.place(row, judge))
            columns = zip(*out) if out else [[]] * 4
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["digest", "story", "action", "seq"])

    return run


def place(summaries: DataFrame, existing: DataFrame | None = None, judge: Judge | None = None, near: DataFrame | None = None) -> DataFrame:
    """(digest, story, action, seq) of every summary (digest, fetched, slug, identifiers; title and body if a judge reads them).

    Each joins the candidate that the judge names or starts a story; a name that is no candidate
    counts as none. Without a judge the first candidate is taken, and `near` is not looked at:
    nearness alone is no reason to join. Candidates share a form with it, or hold what `near` (digest, other, rank) names: the digest of another summary or
    "story:" and the name of one of the `existing` stories (story, first_seen, identifiers,
    perhaps title), which are seeded before. The order of placement matters only inside a
    component, so components are dealt out and each is read as one sorted stream: many small
    ones share a batch, and of a large one only its stories' forms are held, not its rows.

    Components are those of slugs and forms as 64-bit hashes: names settle ties, so a slug joins
    its rows as well. Two that a hash makes one are read as one stream, which changes nothing.
    """
    near = None if judge is None else near
    text = lambda df, c: F.coalesce(F.col(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c)
    own = [F.coalesce("fetched", F.lit("")).alias("fetched"), "slug", "identifiers", F.lit("").alias("story")]
    new = summaries.select("digest", *own)
    if existing is not None:
        new = new.unionByName(existing.select(F.concat(F.lit("story:"), "story").alias("digest"), F.col("first_seen").alias("fetched"), F.col("story").alias("slug"), "identifiers", "story"))
    rows = materialise(new.select("digest", "fetched", "slug", "story", t.form_list(F.col("identifiers")).alias("forms")))
    node = lambda tag, c: F.xxhash64(F.lit(tag), c)
    slug = node("s", F.col("slug"))
    edges = rows.select(slug.alias("a"), F.explode(F.transform("forms", lambda f: node("f", f))).alias("b"))
    if near is not None:
        edges = edges.unionByName(rows.select(slug.alias("a"), node("d", F.col("digest")).alias("b"))).unionByName(near.select(node("d", F.col("digest")).alias("a"), node("d", F.col("other")).alias("b")))
    found = components(edges, local_edges=PLACE_EDGES)
    rows = rows.withColumn("node", slug).join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")
    if judge is not None:
        said = summaries.select("digest", text(summaries, "title"), text(summaries, "body"))
        if existing is not None:
            said = said.unionByName(existing.select(F.concat(F.lit("story:"), "story").alias("digest"), text(existing, "title"), F.lit("").alias("body")))
        nearest = F.array().cast("array<struct<other:string,rank:int>>")
        if near is not None:
            lists = near.groupBy("digest").agg(F.collect_list(F.struct("other", F.col("rank").cast("int").alias("rank"))).alias("near"))
            rows, nearest = rows.join(lists, "digest", "left"), F.coalesce("near", nearest)
        rows = rows.withColumn("near", nearest).join(said, "digest")
    rows = rows.repartition("component").sortWithinPartitions("component", F.col("story") == "", "fetched", "digest")
    return rows.mapInArrow(_fold(judge), PLACED)


def union_identifiers(members: DataFrame, summaries: DataFrame) -> DataFrame:
    """(story, identifiers): over members (story, pos, digest) in order, the first spelling of each form."""
    ids = members.join(summaries.select("digest", "identifiers"), "digest").select("story", "pos", F.posexplode("identifiers").alias("at", "identifier"))
    ids = ids.withColumn("f", t.join_form(F.col("identifier")))
    first = F.row_number().over(Window.partitionBy("story", "f").orderBy("pos", "at"))
    kept = ids.withColumn("nth", first).where("nth = 1").groupBy("story").agg(F.array_sort(F.collect_list(F.struct("pos", "at", "identifier"))).alias("x"))
    return kept.select("story", F.transform("x", lambda s: s["identifier"]).alias("identifiers"))


def seen_range(members: DataFrame, summaries: DataFrame) -> DataFrame:
    """(story, first_seen, last_seen) as texts; a member without summary counts as empty."""
    seen = F.coalesce("fetched", F.lit(""))
    return members.join(summaries.select("digest", "fetched"), "digest", "left").groupBy("story").agg(F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))


def story_body(members: DataFrame, summaries: DataFrame) -> DataFrame:
    """(story, body): a heading and the text of each member that has a summary, in order."""
    return bodies(members.join(summaries.select("digest", "title", "body"), "digest"))


def bodies(rows: DataFrame) -> DataFrame:
    """(story, body) of rows (story, pos, title, body): story_body() where members and texts are joined."""
    part = F.concat(F.lit("## "), "title", F.lit("\n\n"), "body").alias("part")
    found = rows.select("story", "pos", part).groupBy("story").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("x"))
    return found.select("story", F.array_join(F.transform("x", lambda s: s["part"]), "\n\n").alias("body"))


def push_matches(summaries: DataFrame, agents: DataFrame) -> DataFrame:
    """(digest, name, shared): agent pages with a form of a summary, and the summary's spellings, sorted.

    Agent pages that hold the same forms share them with the same summaries, so matches are found
    for one of them; the rows of all are made last and not shuffled.
    """
    spelled = materialise(summaries.select("digest", F.explode("identifiers").alias("raw")).where("raw is not null").withColumn("f", t.join_form(F.col("raw"))).distinct())
    kinds, members = by_class(forms(agents, "name"), "name")
    pairs = shared(spelled.select("digest", "f.key", "f.norm").distinct(), kinds.withColumnRenamed("class", "story"), lists=True)
    lists = spelled.groupBy("digest").agg(F.collect_list(F.struct("f", "raw")).alias("spelled"))
    said = F.filter("spelled", lambda s: F.array_contains("shared", s["f"]))
    found = pairs.join(lists, "digest").select("digest", F.col("story").alias("class"), F.array_sort(F.array_distinct(F.transform(said, lambda s: s["raw"]))).alias("shared"))
    return expanded(materialise(found), members, "name").select("digest", "name", "shared")


def recheck(placements: DataFrame, stories: DataFrame, summary_forms: DataFrame, story_forms: DataFrame) -> DataFrame:
    """placements (digest, target, target_title, seen) with `holds`.

    A join holds while its story has the title it had; a start while no candidate has come
    up that was not seen then. Where the longest `seen` has k stories, one of any k + 1 is not
    seen, so no more stories of a form are looked at, and no list of candidates is made.
    """
    now = stories.select(F.col("story").alias("target"), F.col("title").alias("now_title"))
    seen = F.coalesce("seen", F.array().cast("array<string>"))
    starts = placements.where("target is null").select("digest", seen.alias("was"))
    most = starts.agg(F.coalesce(F.max(F.size("was")), F.lit(0)).alias("k")).first()["k"]
    nth = F.row_number().over(Window.partitionBy("key", "norm").orderBy("story"))
    some = story_forms.select("story", "key", "norm").distinct().withColumn("nth", nth).where(F.col("nth") <= most + 1).drop("nth")
    new = starts.join(summary_forms, "digest").join(some, ["key", "norm"]).where(~F.array_contains("was", F.col("story")))
    out = placements.join(now, "target", "left").join(new.select("digest", F.lit(True).alias("new")).distinct(), "digest", "left")
    return out.withColumn("holds", F.when(F.col("target").isNotNull(), F.col("now_title").eqNullSafe(F.col("target_title"))).otherwise(F.col("new").isNull()))
