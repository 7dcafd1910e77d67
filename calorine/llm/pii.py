"""Surrogates for personal data: keyed, of the same type and form, distinct and consistent over the corpus."""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from calorine.functions.session import discard, saved
from calorine.llm.words import bounded

#: The session setting that holds the key of the query; without it the query uses a key that is no secret.
KEY_SETTING, OPEN_KEY = "calorine.surrogates.key", "no-secret"
#: Entities whose attempt number is sent to all tasks; more are joined by document.
BROADCAST_BUMPS = 50_000
MAX_ROUNDS = 40

#: Given names by script and gender, titles by gender.
NAMES = {
    ("latin", "f"): ["Mary", "Anna", "Laura", "Sophie", "Claire", "Emma", "Julia", "Elena", "Ingrid", "Marta", "Nina", "Helen", "Greta", "Lucia", "Carmen", "Alice"],
    ("latin", "m"): ["John", "Peter", "Paul", "Thomas", "David", "Martin", "Lukas", "Carlos", "Henri", "Stefan", "Oscar", "Miguel", "Robert", "Simon", "Victor", "Adam"],
    ("cyrillic", "f"): ["Анна", "Мария", "Елена", "Ольга", "Ирина", "Татьяна", "Наталья", "Светлана"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Сергей", "Андрей", "Дмитрий", "Николай", "Павел", "Виктор"],
}
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"], "n": ["Dr", "Prof"]}
_PARTS = {"latin": (["ba", "den", "fal", "gor", "hel", "kan", "lor", "mar", "nor", "pel", "ros", "sil", "tor", "vel", "wen", "zan"], ["berg", "dale", "ford", "ley", "man", "ner", "ova", "son", "stein", "ton", "vic", "well"]), "cyrillic": (["ба", "вол", "гор", "дан", "зор", "кал", "лев", "мор", "ор", "пав", "род", "сол"], ["ев", "ин", "ов", "ский"])}

_TITLE = "|".join(t for g in TITLES.values() for t in g)
_WORD = r"[^\W\d_]+"
PATTERNS: list[tuple[str, re.Pattern, str]] = [  # kind, pattern, what a text must hold
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), "@"),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z]{20,})(?![0-9A-Za-z])"), ""),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"), ""),
    ("card", re.compile(r"(?<![\d.-])(?:\d[ -]?){12,18}\d(?![\d-])"), ""),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), "-"),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"), "."),
    ("ipv6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}|:)(?![\w:])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])"), ":"),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"), ""),
]
#: Parts of names: words that begin with no small letter, with hyphens or apostrophes; initials; small words within family names.
_PART = rf"[^\W\d_a-zа-я](?:[^\W\d_]+(?:[-'’]{_WORD})*|(?:[-'’]{_WORD})+)"
_INITIAL = r"[^\W\d_a-zа-я]\."
_SMALL = "van|von|der|den|de|del|della|di|da|dos|du|la|le|ter|bin|al"
TITLED = re.compile(rf"(?<!\w)(?P<title>{_TITLE})\.?[ \n](?P<names>(?:(?:{_PART}|{_INITIAL}|{_SMALL})[ \n])*{_PART})(?!\w)")
PIECE = re.compile(rf"{_PART}|{_INITIAL}")
_FIRST = [n for names in NAMES.values() for n in names]
NAMED = re.compile(rf"(?<![\w'’-])({'|'.join(_FIRST)}) ({_PART})(?!\w)")
_TITLES = {t for g in TITLES.values() for t in g}
_GIVEN = {n.lower() for names in NAMES.values() for n in names}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def canonical(kind: str, text: str) -> str | None:
    """The form in which mentions of one entity agree; None where the text is no such entity after all."""
    if kind == "card":
        d = re.sub(r"\D", "", text)
        return d if 13 <= len(d) <= 19 and luhn(d) and len(set(d)) > 1 else None
    if kind == "ip":
        return text if all(int(x) < 256 for x in text.split(".")) else None
    if kind == "ipv6":
        try:
            return ipaddress.IPv6Address(text).exploded
        except ValueError:
            return None
    if kind == "phone":
        d = re.sub(r"\D", "", text)
        d = d[1:] if len(d) == 11 and d[0] == "1" else d  # with and without the code 1, which the other forms without a code imply
        return d if 7 <= len(d) <= 15 else None
    if kind == "secret":
        return text
    if kind == "iban":
        flat = text.replace(" ", "")
        return flat if 15 <= len(flat) <= 34 and _mod97(flat) == 1 else None
    return text.lower()


def _name_parts(text: str) -> list[tuple[int, int, str, str, str]]:
    """Mentions of the parts of names: those after a title, and all other mentions of the same persons in the text.

    Family names are entities of their own (kind "name"), and so are given names (kind
    "given", with a gender); so 'Mr Smith', 'John Smith' and 'J. Smith' keep parts of one surrogate.
    """
    titled = []
    for m in TITLED.finditer(text):
        pieces = [(m.start("names") + x.start(), m.start("names") + x.end()) for x in PIECE.finditer(m["names"])]
        cut = next((i for i, (s, e) in enumerate(pieces) if text[s:e] in _TITLES), len(pieces))
        while cut and not text[pieces[cut - 1][0]].isupper():
            cut -= 1  # small letters beyond the plain ones
        if cut:
            titled.append((m["title"], pieces[:cut]))
    if any(n in text for n in _FIRST):
        for m in NAMED.finditer(text):  # a listed given name before a family name needs no title
            if text[m.start(2)].isupper() and m[2] not in _TITLES and not any(s < m.end() and m.start() < e for _, p in titled for s, e in p):
                titled.append(("", [m.span(1), m.span(2)]))
    if not titled:
        return []
    family, given, persons = set(), {}, []
    for title, pieces in titled:
        *first, last = [text[s:e].lower() for s, e in pieces]
        if first:
            family.add(last)
            persons.append((last, first))
            named = next((f for f in first if not f.endswith(".")), first[0])
            for f in first:
                if not f.endswith("."):
                    given.setdefault(f, gender_of(named, title))
    for title, pieces in titled:
        only = text[slice(*pieces[0])].lower()
        if len(pieces) == 1 and only not in given:
            family.add(only)
    spots = {(s, e): title for title, pieces in titled for s, e in pieces}
    found, pieces = [], [x.span() for x in PIECE.finditer(text) if not x.start() or not (text[x.start() - 1].isalnum() or text[x.start() - 1] == "_")]
    for i in range(len(pieces) - 1, -1, -1):  # backwards: a family name tells of what stands before it
        s, e = pieces[i]
        word = text[s:e].lower()
        after = found[-1] if found and text[e : found[-1][0]] in (" ", "\n") else None
        if word.endswith("."):
            if after is None and (s, e) not in spots:
                continue
            held = after[3] if after else ""
            full = next((f for last, first in persons for f in first if f[0] == word[0] and not f.endswith(".") and (last == held or held in first)), None)
            gender = given[full] if full else gender_of(word, spots.get((s, e), ""))
            found.append((s, e - 1, "given", full or word, gender))
        elif word in family and not (word in given and after):
            found.append((s, e, "name", word, ""))
        elif word in given or (after and word in _GIVEN):
            found.append((s, e, "given", word, given.get(word) or gender_of(word, "")))
        elif "-" in word or "'" in word or "’" in word:  # a known part within a longer one: 'Smith's', 'Smith-Jones'
            for x in reversed(list(re.finditer(_WORD, text[s:e]))):
                w = x[0].lower()
                if w in family or w in given:
                    found.append((s + x.start(), s + x.end(), "name" if w in family else "given", w, "" if w in family else given[w]))
    return found


def mentions(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, canonical, context) of the entities of a text, without overlaps; earlier kinds come first."""
    found: list[tuple[int, int, str, str, str]] = []
    digits = any(c in text for c in "0123456789")
    for kind, pattern, need in PATTERNS:
        if (kind in ("ip", "ipv6", "phone", "card", "ssn", "iban", "secret") and not digits) or (need and need not in text):
            continue
        for m in pattern.finditer(text):
            c = canonical(kind, m[0])
            if c is not None and not any(m.start() < y and x < m.end() for x, y, *_ in found):
                found.append((*m.span(), kind, c, ""))
    found += [n for n in _name_parts(text) if not any(n[0] < y and x < n[1] for x, y, *_ in found)]
    return sorted(found)


def counted(text: str, found: list[tuple[int, int, str, str, str]]) -> int:
    """Mentions of entities; parts of one name that stand together count once."""
    parts, gap = ("name", "given"), re.compile(rf"[ \n](?:(?:{_SMALL})[ \n])*")
    together = lambda a, b: gap.fullmatch(text, a[1] + (a[1] - a[0] == 1 and text[a[1]] == "."), b[0])
    return len(found) - sum(a[2] in parts and b[2] in parts and together(a, b) is not None for a, b in zip(found, found[1:], strict=False))


class Stream:
    """Keyed choices for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        seed = hashlib.blake2b(f"{kind}\0{entity}\0{attempt}".encode(), key=key[:64], digest_size=32).digest()
        self.left = int.from_bytes(hashlib.shake_256(seed).digest(64 + 2 * len(entity)), "little")

    def below(self, n: int) -> int:
        self.left, r = divmod(self.left, n)
        return r

    def like(self, text: str, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
        """Digits for digits and letters for letters, small and capital; all else stays."""
        return "".join(str(self.below(10)) if c.isdigit() else letters[self.below(len(letters))] if c.islower() else letters[self.below(len(letters))].upper() if c.isupper() else c for c in text)

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))


def script_of(text: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in text) else "latin"


def gender_of(names: str, title: str) -> str:
    for g in "fm":
        if title in TITLES[g] or any(names.split()[0].lower() == n.lower() for n in NAMES[script_of(names), g]):
            return g
    return "f" if names.split()[0].lower().endswith(("a", "а", "я")) else "m"


def surrogate(kind: str, entity: str, attempt: int, key: bytes, gender: str = "") -> str:
    """The canonical surrogate: same kind, length classes, checksum and (names) gender and script."""
    r = Stream(key, kind, entity, attempt)
    if kind == "email":  # as long, with the same marks and the same last label; longer where short ones are used up
        local, _, domain = entity.partition("@")
        labels, _, top = domain.rpartition(".")
        return f"{r.like(local)}{r.like('x' * (attempt // 4))}@{r.like(labels)}.{top}"
    if kind == "secret":
        prefix = next((p for p in ("AKIA", "ghp_", "sk-") if entity.startswith(p)), "")
        letters = "abcdef" if not prefix else "abcdefghijklmnopqrstuvwxyz"
        return prefix + r.like(entity[len(prefix) :], letters)
    if kind == "ipv6":
        return "2001:0db8:" + ":".join(f"{r.below(1 << 16):04x}" for _ in range(6))
    if kind == "card":
        body = entity[0] + r.digits(len(entity) - 2)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "iban":
        body = entity[:2] + "00" + "".join(r.digits(1) if c.isdigit() else chr(65 + r.below(26)) for c in entity[4:])
        return f"{body[:2]}{98 - _mod97(body):02d}{body[4:]}"
    if kind == "ssn":
        return f"9{r.digits(2)}-{r.digits(2)}-{r.digits(4)}"
    if kind == "ip":
        return ".".join(str(1 + r.below(254)) for _ in range(4))
    if kind == "phone":
        keep = max(0, len(entity) - 10)
        return entity[:keep] + str(2 + r.below(8)) + r.digits(len(entity) - keep - 1)
    script = script_of(entity)
    first, last = _PARTS[script]
    if kind == "given":
        names, end = NAMES[script, gender or gender_of(entity, "")], {"latin": "ao", "cyrillic": "ая"}[script]
        if attempt < 3:
            return "-".join(names[r.below(len(names))] for _ in entity.split("-"))
        made = "".join(first[r.below(len(first))] for _ in range(1 + attempt // 3)).capitalize()
        return made + (end[0] if gender == "f" else "" if script == "cyrillic" else end[1])
    family = ("".join(first[r.below(len(first))] for _ in range(2 + attempt // 2)) + last[r.below(len(last))]).capitalize()
    given = NAMES[script, gender or gender_of(entity, "")]
    return family if " " not in entity else f"{given[r.below(len(given))]} {family}"


def render(kind: str, original: str, made: str) -> str:
    """The surrogate in the form of a mention: its separators, grouping and case."""
    if kind == "phone":  # a code before the number stays
        places = [i for i, c in enumerate(original) if c.isdigit()][-len(made) :]
        return "".join(dict(zip(places, made, strict=True)).get(i, c) for i, c in enumerate(original))
    if kind == "secret":
        return made
    if kind in ("card", "iban"):
        left = iter(made)
        return "".join(next(left, "") if c.isalnum() else c for c in original) + "".join(left)
    if kind == "given" and len(original) == 1:
        return made[0]
    if kind in ("email", "name", "given") and original.upper() == original and any(c.isalpha() for c in original):
        return made.upper()
    return made if kind not in ("name", "given") or original != original.lower() else made.lower()


def _entity_key(kind: str, canon: str, context: str) -> tuple[str, str, str]:
    return kind, canon, context


def _per_doc(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, entity, gender) of the distinct entities of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(doc, *e) for e in dict.fromkeys(_entity_key(k, c, x) for _, _, k, c, x in mentions(text or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i == 0 else pa.string()) for i in range(4)], names=["doc_id", "kind", "entity", "gender"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, kind string, entity string, gender string")


def assign(entities: DataFrame, key: bytes, make: Callable = surrogate) -> DataFrame:
    """(kind, entity, gender, attempt, made) of distinct entities: no two of a kind share a surrogate, and none is an entity of the corpus.

    Where several entities have the same surrogate, the one of least hash keeps it and the others try
    again; so does one whose surrogate is itself an entity, or one held already. Each
    round is a grouped aggregation over the surrogates in play.
    """

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, entity, gender, attempt = (batch.column(i).to_pylist() for i in range(4))
            made = [make(k, e, a, key, g) for k, e, g, a in zip(kind, entity, gender, attempt, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(made, pa.string())], names=["kind", "entity", "gender", "attempt", "made"])

    schema = "kind string, entity string, gender string, attempt int, made string"
    names = entities.select("kind", F.lower("entity").alias("low")).distinct()  # names are made with capitals
    open_ = entities.withColumn("attempt", F.lit(0))
    held = None
    for _ in range(MAX_ROUNDS):
        proposed = saved(open_.mapInArrow(propose, schema), "surrogates")
        first = proposed.groupBy("kind", "made").agg(F.min_by(F.struct("entity", "gender"), F.struct(F.xxhash64("entity", "gender"), "entity", "gender")).alias("first"))
        free = first.withColumn("low", F.lower("made")).join(names, ["kind", "low"], "left_anti").drop("low")
        if held is not None:
            free = free.join(held.select("kind", "made"), ["kind", "made"], "left_anti")
        won = saved(proposed.join(free, ["kind", "made"]).where((F.col("entity") == F.col("first.entity")) & (F.col("gender") == F.col("first.gender"))).select("kind", "entity", "gender", "attempt", "made"), "surrogates-held")
        rest = proposed.join(won.select("kind", "entity", "gender"), ["kind", "entity", "gender"], "left_anti")
        held = won if held is None else held.union(won)
        rest = saved(rest.select("kind", "entity", "gender", (F.col("attempt") + 1).cast("int").alias("attempt")), "surrogates-open")
        discard(proposed, open_)
        if rest.isEmpty():
            return held
        open_ = rest
    raise RuntimeError("surrogates of some kind are used up")


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with each entity of the texts replaced, then n_entities (int) and kinds (array of names, sorted).

    Detected kinds: e-mail, secret, IBAN, card (with check digit), SSN, IPv4, IPv6, phone,
    and names: those after a title or with a listed given name, and all mentions of their
    parts in the same text. `key` is the caller's secret: who has it can find originals by trying. All
    mentions of an entity over the corpus get one surrogate, different entities different
    ones; family and given names are entities of their own (given names told apart by gender
    too). Null text stays null; texts without entities stay as they are; repeated
    rows are replaced alike. Columns named n_entities or kinds are renamed docs_*.
    Surrogates are computed from key and entity; only the attempt numbers above 0
    are looked up, from a broadcast table below a checked size and else by doc_id.
    """
    docs = docs.withColumnsRenamed({c: f"docs_{c}" for c in ("n_entities", "kinds", "pii_bumps") if c in docs.columns})
    seen = saved(_per_doc(bounded(docs)), "pii-entities")
    held = assign(seen.select("kind", "entity", "gender").distinct(), key)
    bumped = held.where("attempt > 0").select("kind", "entity", "gender", "attempt")
    first = bumped.limit(BROADCAST_BUMPS + 1).collect()
    small = len(first) <= BROADCAST_BUMPS
    table = docs.sparkSession.sparkContext.broadcast({tuple(r)[:3]: r[3] for r in first} if small else {})
    if small:
        source, own = docs, 0
    else:
        per = seen.join(bumped, ["kind", "entity", "gender"]).groupBy(F.col("doc_id").alias("pii_doc")).agg(F.collect_set(F.struct("kind", "entity", "gender", "attempt")).alias("pii_bumps"))
        source, own = docs.join(per, F.col("doc_id").cast("long").eqNullSafe(F.col("pii_doc")), "left").drop("pii_doc"), 1
    where = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_entities", T.IntegerType()), T.StructField("kinds", T.ArrayType(T.StringType()))])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, kinds = [], [], []
            bumps = batch.column(batch.num_columns - 1).to_pylist() if own else None
            for i, text in enumerate(batch.column(where).to_pylist()):
                found = mentions(text or "")
                more = {(b["kind"], b["entity"], b["gender"]): b["attempt"] for b in bumps[i] or ()} if own else table.value
                parts, at = [], 0
                for s, e, kind, canon, context in found:
                    which = _entity_key(kind, canon, context)
                    parts += [text[at:s], render(kind, text[s:e], surrogate(kind, canon, more.get(which, 0), key, which[2]))]
                    at = e
                texts.append("".join([*parts, text[at:]]) if found else text)
                counts.append(counted(text or "", found))
                kinds.append(sorted({"name" if f[2] == "given" else f[2] for f in found}))
            columns = list(batch.columns[: batch.num_columns - own])
            columns[where] = pa.array(texts, batch.schema.field(where).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32()), pa.array(kinds, pa.list_(pa.string()))], names=[*batch.schema.names[: len(columns)], "n_entities", "kinds"])

    return source.mapInArrow(rewrite, schema)


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(KEY_SETTING, OPEN_KEY).encode())
