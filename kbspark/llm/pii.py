"""PII surrogates: keyed, type-consistent, distinct and coreferent replacements of entities."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.session import materialise

# Given names by script and gender, and what precedes a person's name.
GIVEN = {
    ("latin", "f"): "Aisha Alice Amelia Ana Anna Beatrice Caroline Catherine Charlotte Clara Dorothy Elizabeth Emily Emma Florence Hannah Helen Ingrid Isabella Jane Jennifer Jessica Julia Laura Linda Louise Margaret Maria Martha Mary Natalie Olivia Patricia Rebecca Sarah Sophia Susan Teresa Victoria Virginia Yvonne",
    ("latin", "m"): "Ahmed Albert Alexander Ali Andrew Anthony Benjamin Charles Carlos Christopher Daniel David Dominic Edward Frederick George Gregory Henry Ibrahim Jan James Javier John Jonathan José Juan Joseph Kenneth Lawrence Leonard Martin Matthew Michael Mohammed Muhammad Nicholas Omar Oliver Patrick Peter Philip Richard Robert Samuel Stephen Thomas Timothy Walter William",
    ("cyrillic", "f"): "Анастасия Валентина Вера Галина Дарья Екатерина Елена Жанна Зинаида Ирина Ксения Людмила Марина Наталья Ольга Полина Светлана Татьяна",
    ("cyrillic", "m"): "Александр Борис Василий Виктор Владимир Георгий Дмитрий Евгений Иван Константин Максим Михаил Николай Павел Роман Сергей Степан Юрий",
    ("greek", "f"): "Αικατερίνη Βασιλική Δήμητρα Ελένη Ευαγγελία Ιωάννα Κωνσταντίνα Μαρία Παρασκευή Σοφία",
    ("greek", "m"): "Αθανάσιος Γεώργιος Δημήτριος Ευάγγελος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης Σπυρίδων Χρήστος",
}
TITLES = {"f": "Mrs. Mrs Ms. Ms Miss Frau Madame Mme Señora Sra. г-жа Κυρία", "m": "Mr. Mr Herr Monsieur Señor Sr. г-н Κύριος", "": "Dr. Dr Prof. Prof Professor Doctor Rev."}
# Syllables of surnames, by script: consonant beginnings and vowel-bearing ends.
SYLLABLES = {
    "latin": ("B C D F G H K L M N P R S T V W".split(), "al an ar el en er il in on or ul um".split()),
    "cyrillic": ("Б В Г Д З К Л М Н П Р С Т Ф".split(), "ал ан ар ел ен ер ил ин ол он ор ун".split()),
    "greek": ("Β Γ Δ Ζ Κ Λ Μ Ν Π Ρ Σ Τ Φ".split(), "αλ αν αρ ελ εν ερ ιλ ιν ολ ον ορ".split()),
}
# Endings that make a given name of either gender of a syllable or more.
ENDINGS = {
    ("latin", "f"): "a ia ina elle ette".split(),
    ("latin", "m"): "o us en ard win".split(),
    ("cyrillic", "f"): "а ия ина".split(),
    ("cyrillic", "m"): "ор ий им".split(),
    ("greek", "f"): "α ία η".split(),
    ("greek", "m"): "ος ιος ης".split(),
}

KIND = {name: key for key, names in GIVEN.items() for name in names.split()}
GENDER = {title: g for g, titles in TITLES.items() for title in titles.split()}
_CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω][a-zß-öø-ÿа-яёά-ώ]+"
NUMBERED = re.compile(
    "|".join(
        [
            r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24})",
            r"(?P<key>\bAKIA[0-9A-Z]{16}\b)",
            r"(?:\b(?i:token|secret|password|passwd|api_?key|access_?key)\b\s{0,3}[=:]\s{0,3}[\"']?)(?P<secret>[A-Za-z0-9_/+-]{16,})",
            r"(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
            r"(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,12}(?:[ .-][0-9]{1,12}){0,7}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-]))",
            r"(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))",
            r"(?P<ip>(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9]))",
            r"(?P<card>(?<![0-9])(?:[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}|[0-9]{13,19})(?![0-9]))",
        ]
    )
)
# Looked for only where a cheaper pattern holds: eight groups or a double colon, told apart by the library.
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_COLONS = re.compile("::[0-9A-Fa-f]|:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:")
PERSON = re.compile(
    rf"(?:(?<!\w)(?P<title>{'|'.join(map(re.escape, sorted(GENDER, key=len, reverse=True)))})\s+)(?P<titled>{_CAPITAL}(?:[ -]{_CAPITAL}){{0,2}})"
    rf"|(?P<named>\b(?:{'|'.join(KIND)})(?:[ -]{_CAPITAL}){{1,2}})"
)
# Quick looks that most texts fail, before the patterns above.
_DIGIT = re.compile("[0-9@]")
_WORDS = ("akia", "token", "secret", "passw", "key")
_ALONE = re.compile(rf"(?<!\w){_CAPITAL}(?!\w)")


@lru_cache(maxsize=1)
def _names():
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for word in [*KIND, *GENDER]:
        found.add_word(word)
    found.make_automaton()
    return found


def _may_name(text: str) -> bool:
    """A given name or a title stands somewhere as a word, with something behind it."""
    follows = lambda c: c.isspace() or c == "-"
    return any((end - n < 0 or not text[end - n].isalnum()) and follows(text[end + 1 : end + 2]) for end, n in _names().iter(text))


def _script(word: str) -> str:
    return "cyrillic" if "А" <= word[0] <= "я" or word[0] in "Ёё" else "greek" if "Ά" <= word[0] <= "ώ" else "latin"


def luhn(digits: str) -> int:
    """Sum mod 10 of the check that payment card numbers pass with 0."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def _account(value: str) -> bool:
    """The check of an account number: read as base 36 from its fifth place on, it is 1 mod 97."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _address(value: str) -> str | None:
    try:
        return ipaddress.IPv6Address(value).compressed
    except ValueError:
        return None


def _named_secret(text: str) -> bool:
    return any(w in text for w in _WORDS)


def _digits(value: str) -> str:
    return ("+" if value[0] == "+" else "") + re.sub("[^0-9]", "", value)


def _phone(value: str) -> str:
    """A number without the groups behind it: those over 15 digits, and single digits after 10."""
    while value[0] == "+" and (cut := re.search("[ .-][0-9]+$", value)):
        n = len(_digits(value)) - 1
        single = len(cut.group()) == 2 and cut.group()[0] != "-" and n > 10
        if n <= 15 and not single:
            break
        value = value[: cut.start()]
    return value


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of the entities of a text; mentions of one entity share the last two."""
    out = []
    if _DIGIT.search(text) or _named_secret(text.lower()):
        at = 0
        while m := NUMBERED.search(text, at):
            kind = "card" if m.lastgroup == "gap" else m.lastgroup
            start, at = m.span(kind)
            value = m.group(kind)
            if kind == "phone":
                value = _phone(value)
                at = start + len(value)
            if kind in ("phone", "card", "ssn"):
                form = _digits(value)
                if kind == "ssn" or (kind == "phone" and 7 <= len(form.lstrip("+")) <= 15) or (kind == "card" and luhn(form) == 0):
                    out.append((start, at, kind, form))
            elif kind == "iban":
                if _account(form := value.replace(" ", "")):
                    out.append((start, at, kind, form))
            else:
                out.append((start, at, kind, value.lower() if kind == "email" else value.replace(" ", "")))
    if _COLONS.search(text):
        # A time such as 10:20:30 is no address.
        out += [(*m.span(), "ipv6", form) for m in IPV6.finditer(text) if (form := _address(m.group()))]
    if _may_name(text):
        for m in PERSON.finditer(text):
            kind = "titled" if m.group("titled") else "named"
            gender, at = GENDER.get(m.group("title") or "", ""), m.start(kind)
            surname = m.group(kind).rfind(" ")
            for word in re.finditer("[^ -]+", m.group(kind)):
                w = word.group()
                # All words before the surname are given names, of the title's gender if the name is unknown.
                if word.start() < surname:
                    script, sex = KIND.get(w, (_script(w), gender))
                    form = f"given-{script}-{sex}"
                else:
                    form = f"family-{_script(w)}"
                out.append((at + word.start(), at + word.end(), form, w))
        # A surname stands for its person in the rest of the text as well.
        families = {w: form for *_, form, w in out if form.startswith("family-")}
        if families:
            out += [(*m.span(), families[m.group()], m.group()) for m in _ALONE.finditer(text) if m.group() in families]
        every, out, end = sorted(set(out), key=lambda x: (x[0], -x[1])), [], 0
        for x in every:
            if x[0] >= end:
                out.append(x)
                end = x[1]
    return out


class _Stream:
    """Numbers drawn from an HMAC of the entity."""

    def __init__(self, key: bytes, *parts: str) -> None:
        self.key, self.seed, self.block, self.left = key, "\0".join(parts).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hmac.new(self.key, self.seed + b"\0%d" % self.block, hashlib.sha256).digest()
            self.block += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x % n


def _shape(draw: _Stream, text: str) -> str:
    """Letters for letters of their case (hex for hex), digits for digits, all else as it is."""
    hexes = re.fullmatch("(?=.*[a-fA-F])(?:[0-9a-f]{16,}|[0-9A-F]{16,})", text) is not None
    low, up = ("abcdef", "ABCDEF") if hexes else ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    if hexes:
        pool = "0123456789" + (up if any(c.isupper() for c in text) else low)
        return "".join(pool[draw.below(16)] for _ in text)
    return "".join(low[draw.below(26)] if "a" <= c <= "z" else up[draw.below(26)] if "A" <= c <= "Z" else str(draw.below(10)) if c.isdigit() else c for c in text)


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The replacement of a normal form: the same for every mention, another for every attempt.

    Every eight attempts the space it is drawn from is widened, so that however many entities
    share a short form, such as the addresses a@b.co or 192.168.x.y, there are others left.
    """
    draw, wider = _Stream(key, kind, value, str(attempt)), attempt // 8
    if kind == "email":
        local, domain = value.split("@")
        host, top = domain.rsplit(".", 1)
        more = "".join(chr(97 + draw.below(26)) for _ in range(wider))
        return f"{_shape(draw, local)}{more}@{_shape(draw, host)}.{top}"
    if kind == "key":
        return "AKIA" + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[draw.below(32)] for _ in value[4:])
    if kind == "secret":
        return _shape(draw, value)
    if kind == "iban":
        body = "".join(_shape(draw, c) for c in value[4:])
        number = int("".join(str(int(c, 36)) for c in body + value[:2] + "00"))
        return f"{value[:2]}{98 - number % 97:02d}{body}"
    if kind == "ip":
        parts = value.split(".")
        keep = 1 if parts[0] in ("10", "127") else 2 if parts[:2] == ["192", "168"] or (parts[0] == "172" and 16 <= int(parts[1]) <= 31) else 0
        # A public address stays public: first places from 11 to 99 other than 10 and 127.
        new = [str(11 + draw.below(89)) if i == 0 else str(1 + draw.below(254)) for i in range(4)]
        if wider and keep == 2:
            keep, parts = 1, ["10"]  # as private, and 65,536 times as many
        elif wider > 1:
            keep, new[0] = 0, str(11 + draw.below(213))
        return ".".join(parts[:keep] + new[keep:])
    if kind == "ipv6":
        groups = ipaddress.IPv6Address(value).exploded.split(":")
        private = groups[0][:2] in ("fc", "fd") or groups[0] == "fe80"
        # Private ones keep their first group, public ones stay public; zero groups stay zero but for the last four.
        first = groups[0] if private else f"2{draw.below(4096):03x}"
        rest = [g if g == "0000" and i < 4 and wider < 1 else f"{1 + draw.below(65535):x}" for i, g in enumerate(groups[1:], 1)]
        return ipaddress.IPv6Address(":".join([first, *rest])).compressed
    if kind == "card":
        new = value[0] + "".join(str(draw.below(10)) for _ in value[1:-1])
        return new + next(d for d in "0123456789" if (luhn(new + d) == 0) == (luhn(value) == 0))
    if kind == "phone":
        keep = (2 if value[1] in "17" else 3) if value[0] == "+" else 0
        return value[:keep] + "".join(str(2 + draw.below(8)) if i in (0, 3) else str(draw.below(10)) for i in range(len(value) - keep + wider))
    if kind == "ssn":
        return str(draw.below(10) if wider else 1 + draw.below(8)) + "".join(str(draw.below(10)) for _ in value[1:])
    part, script, *sex = kind.split("-")
    if part == "given":
        ends = ENDINGS.get((script, sex[0])) or ENDINGS[script, "f"] + ENDINGS[script, "m"]
        last = ends[draw.below(len(ends))]
    else:
        last = ""
    starts, ends = SYLLABLES[script]
    # After a few tries a syllable is added, so there is always another.
    parts = [starts[draw.below(len(starts))] + ends[draw.below(len(ends))] for _ in range((2 if last else 3) + attempt // 4)]
    return parts[0] + "".join(parts[1:]).lower() + last


def written(mention: str, kind: str, new: str) -> str:
    """A surrogate in the form of a mention: its separators and upper-case letters."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(new.lstrip("+"))
        return "".join(next(digits) if c.isdigit() else c for c in mention) + "".join(digits)
    if kind == "iban":
        letters = iter(new)
        return "".join(c if c == " " else next(letters) for c in mention)
    if kind == "email":
        local, at, domain = mention.partition("@")
        mine, _, host = new.partition("@")
        upper = lambda like, text: "".join(n.upper() if c.isupper() else n for c, n in zip(like, text)) + text[len(like) :]
        return upper(local, mine) + at + upper(domain, host)
    return new


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair = pa.struct([("kind", pa.string()), ("value", pa.string())])
    for batch in batches:
        lists = [[{"kind": k, "value": v} for k, v in dict.fromkeys((k, v) for *_, k, v in find(t or ""))] for t in batch.column("body").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pair))], [*batch.schema.names, "entities"])


def _named(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "attempt")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(key, *r) for r in rows], pa.string())], [*batch.schema.names, "surrogate"])

    return run


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = [], []
        for text, pairs in zip(batch.column("body").to_pylist(), batch.column("pairs").to_pylist()):
            new, out, at, n = {(p["kind"], p["value"]): p["surrogate"] for p in pairs}, [], 0, 0
            for start, end, kind, value in find(text):
                out += [text[at:start], written(text[start:end], kind, new[kind, value])]
                at, n = end, n + 1
            texts.append("".join(out) + text[at:])
            counts.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["row", "text", "n"])


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate) for distinct entities (kind, value), no two of a kind sharing one.

    A surrogate that another entity of its kind has, or that is itself found as an entity, is
    drawn again; of several with one surrogate the least value keeps it. The checks group by
    surrogate, so groups are as small as collisions are rare. Only entities drawn again are
    drawn and written anew, and as spaces widen with the attempts the rounds come to an end.
    """
    now = materialise(entities.select("kind", "value", F.lit(0).alias("attempt")).mapInArrow(_named(key), "kind string, value string, attempt int, surrogate string"))
    # Given names of either gender may be asked for together.
    pool = F.regexp_replace("kind", "^(given-[a-z]+)-.*$", "$1").alias("pool")
    real = entities.select(pool, F.col("value").alias("surrogate"), F.lit(True).alias("real")).distinct()
    while True:
        nth = F.row_number().over(Window.partitionBy("pool", "surrogate").orderBy("attempt", "value", "kind"))
        checked = now.withColumn("pool", pool).withColumn("nth", nth).join(real, ["pool", "surrogate"], "left")
        checked = materialise(checked.select("kind", "value", "attempt", "surrogate", ((F.col("nth") > 1) | F.coalesce("real", F.lit(False))).alias("again")))
        if not checked.where("again").limit(1).count():
            return checked.select("kind", "value", "surrogate")
        anew = checked.where("again").select("kind", "value", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_named(key), "kind string, value string, attempt int, surrogate string")
        now = materialise(checked.where("not again").select("kind", "value", "attempt", "surrogate").unionByName(anew))


def replace_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text with surrogates for its entities, n_entities (mentions).

    Emails, phone numbers, card and account numbers whose checks hold, social security numbers,
    IP addresses of both kinds, access keys and secrets, and names of persons (after a title, or a known given name before a
    surname, and that surname alone elsewhere in the text) are replaced; what no pattern finds is left as it is, byte for byte. An entity
    has one surrogate in all documents and forms of writing, and different entities have
    different ones. Surrogates keep shape, separators, letter case, country code, card
    check and issuer digit, private networks, and a name's script and gender. The same key
    gives the same surrogates unless collisions differ. Null text stays null and has none.
    No rows give no rows; repeated rows are all returned; other columns are not read.

    Very long texts are searched whole; ties do not arise, as an entity's surrogate goes by its
    normal form alone. Only distinct entities are shuffled for the assignment. Texts without entities pass
    through a map; texts with some are joined to their surrogates by the text's hash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("body"))
    found = rows.mapInArrow(_found, f"row {kind}, body string, entities array<struct<kind:string,value:string>>")
    plain = found.where(F.size("entities") == 0).select("row", F.col("body").alias("text"), F.lit(0).cast("long").alias("n"))
    text_hash = F.unhex(F.md5(F.col("body").cast("binary"))).alias("text_hash")
    held = found.where(F.size("entities") > 0).select("row", "body", text_hash, "entities")
    mentions = materialise(held.select("text_hash", F.explode("entities").alias("e")).select("text_hash", "e.kind", "e.value").distinct())
    assigned = assign(mentions.select("kind", "value").distinct(), key)
    pairs = mentions.join(assigned, ["kind", "value"]).groupBy("text_hash").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("pairs"))
    changed = held.select("row", "body", "text_hash").join(pairs, "text_hash").select("row", "body", "pairs").mapInArrow(_replaced, f"row {kind}, text string, n long")
    return plain.unionByName(changed).select(F.col("row").alias(id_col), F.col("text").alias(text_col), F.col("n").alias("n_entities"))
