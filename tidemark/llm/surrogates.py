"""Replacement of personal data by surrogates that keep type, format, gender and script.

A surrogate is a keyed hash of the entity spelled in the entity's own form: digits for digits, letters for
letters of the same case and script, separators kept, card numbers with a right or wrong check digit like the
original, names with the title's gender. The same entity gets the same surrogate wherever it stands, whatever
its separators. Names are found after titles; their words are entities of their own, so that parts of a name keep
their surrogate, and every other mention of these words in the document is replaced as well, before or after. Surrogates are checked over the corpus: two entities never share one, and none equals an entity
that occurs. Entities that fail draw again, all but the smallest of those that share; names, addresses and
passwords get longer with each attempt, so that any number of them finds surrogates. Digits stay digits, so other
spaces are finite: what finds nothing free in ``ROUNDS`` draws, as its shape is crowded, takes the value of the next
entity of this shape in a keyed order, which is still another's alone and never its own, but one that occurs.

Defined results: null texts stay null, empty ones empty; texts without entities are unchanged; repeated rows get
equal texts; empty tables give empty results; all columns are kept, with ``text`` (and ``n_chars`` where there
is one) replaced and ``n_entities`` added.
"""

from __future__ import annotations

import hashlib
import ipaddress
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import ordered_rank
from tidemark.sources.lineage import settle

KEY = "tidemark-surrogates"  # a deployment passes its own secret

MALE = "Mr Herr Herrn Señor Sr Monsieur Don г-н κ.".split()
FEMALE = "Mrs Ms Miss Frau Señora Sra Srta Madame Mme Mlle Doña г-жа κα".split()
NEUTRAL = "Dr Prof Professor Mx д-р".split()
TITLES = {t: "m" for t in MALE} | {t: "f" for t in FEMALE} | {t: "n" for t in NEUTRAL}
TITLE = "(?:" + "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True)) + ")"
CAPITAL = r"[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]+"
PATTERN = re.compile(
    r"(?P<email>[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})"
    r"|(?<![\w.])(?P<ip>(?:\d{1,3}\.){3}\d{1,3})(?!\d|\.\d)"
    r"|(?<![\w:.])(?P<ip6>(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{2,39})(?![\w:]|\.\d)"
    r"|(?<!\w)(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?<!\w)(?P<awskey>AKIA[A-Z0-9]{16})(?!\w)"
    r"|(?<!\w)(?P<card>\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\w)"
    r"|(?<!\w)(?P<ssn>\d{3}-\d{2}-\d{4})(?!\w)"
    r"|(?<!\w)(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}|\+\d{8,15}"
    r"|(?=\+(?:[ .()-]{0,3}\d){7,15}(?!\w))\+\d{1,3}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,8})){1,7}|0\d{2,5}[ .-]\d{5,8}|0\d(?:[ .-]\d\d){4}|\d{3}-\d{4})(?!\w)"
    r"|(?i:password|passwd|secret|token)\s?[=:]\s?(?P<password>[\w!#$%&*+/-]{6,})"
    r"|[\"'](?P<hexkey>[0-9a-f]{32,64})[\"']"
    r"|(?<!\w)(?:" + TITLE + r"\.? )+(?!" + TITLE + r"(?!\w))(?P<name>" + CAPITAL + r"(?: " + CAPITAL + r")?)")
WORD = re.compile(r"(?<!\w)" + CAPITAL)
TITLE_WORDS = tuple(t + " " for t in TITLES) + tuple(t + ". " for t in TITLES)

# Syllables that names are made of, for each script and gender.
SYLLABLES = {
    "latin": ("be da fo ga ka le mi no ra sa ti vo wi zu".split(), {"m": "ren tor mund bert las nik".split(), "f": "lina ra sia nette mara lisa".split(), "n": "vin dal rell quis".split()}),
    "cyrillic": ("ба ве го да ко ли ма не ра са ти".split(), {"m": "мир слав тор дан".split(), "f": "мила лина сия рина".split(), "n": "вен лук рад".split()}),
    "greek": ("βα δε γο κα λε μι νο ρα σα".split(), {"m": "νης ρος μος".split(), "f": "λια ρινα μαρα".split(), "n": "θων ξις".split()}),
}


class Draw:
    """Numbers from a keyed hash of one entity and attempt."""

    def __init__(self, key: str, kind: str, entity: str, attempt: int):
        self.seed = f"{kind}\x00{entity}\x00{attempt}".encode()
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        self.pool, self.block = b"", 0

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.blake2b(self.seed + self.block.to_bytes(4, "big"), key=self.key).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n


def canonical(kind: str, text: str) -> str:
    """The entity whatever its separators or case."""
    if kind in ("card", "ssn", "iban"):
        return re.sub(r"[ -]", "", text)
    if kind == "phone":
        country = re.match(r"\+\d{1,3}(?=[ .(-])", text)
        lead = country.group() if country else text[:2] if text[0] == "+" else ""
        return lead + "|" + re.sub(r"\D", "", text[len(lead):])
    if kind == "email":
        return text.lower()
    if kind == "ip6":
        return ipaddress.ip_address(text).exploded
    return text


def luhn(digits: str) -> int:
    return sum(int(d) if k % 2 == 0 else (2 * int(d)) // 10 + (2 * int(d)) % 10 for k, d in enumerate(reversed(digits))) % 10


def like(draw: Draw, text: str) -> str:
    """Letters for letters, digits for digits."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isalpha():
            base, n = (0x430, 32) if "Ѐ" <= c <= "ӿ" else (0x3B1, 17) if "Ͱ" <= c <= "Ͽ" else (0x61, 26)
            x = chr(base + draw.below(n))
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: str, kind: str, entity: str, attempt: int) -> str:
    """The canonical surrogate of a canonical entity."""
    draw = Draw(key, kind, entity, attempt)
    if kind == "ip":
        return ".".join(str(n) for n in (1 + draw.below(223), draw.below(256), draw.below(256), 1 + draw.below(254)))
    if kind == "ip6":
        return ":".join(f"{draw.below(65536):04x}" for _ in range(8))
    if kind == "card":
        body = entity[0] + like(draw, entity[1:-1])
        check = (10 - luhn(body + "0")) % 10
        return body + str(check if luhn(entity) == 0 else (check + 1 + draw.below(9)) % 10)
    if kind == "email":
        name, _, host = entity.partition("@")
        head, dot, top = host.rpartition(".")
        return like(draw, name + "a" * attempt) + "@" + like(draw, head) + dot + top
    if kind == "phone":
        lead, _, rest = entity.partition("|")
        return lead + "|" + like(draw, rest)
    if kind == "iban":
        return entity[:2] + like(draw, entity[2:])
    if kind == "awskey":
        return "AKIA" + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[draw.below(32)] for _ in entity[4:])
    if kind == "hexkey":
        return "".join("0123456789abcdef"[draw.below(16)] for _ in entity)
    if kind[:4] == "name":
        script = "cyrillic" if re.search("[Ѐ-ӿ]", entity) else "greek" if re.search("[Ͱ-Ͽ]", entity) else "latin"
        parts, ends = SYLLABLES[script]
        last = ends[kind[-1]]
        return ("".join(parts[draw.below(len(parts))] for _ in range(3 + attempt)) + last[draw.below(len(last))]).capitalize()
    return like(draw, entity + "a" * attempt if kind == "password" else entity)


def render(kind: str, seen: str, new: str) -> str:
    """The canonical surrogate in the form that the entity has in the text."""
    if kind in ("card", "ssn", "iban"):
        fresh = iter(new)
        return "".join(c if c in " -" else next(fresh) for c in seen)
    if kind == "phone":
        lead, _, rest = new.partition("|")
        fresh = iter(rest)
        return lead + "".join(next(fresh) if c.isdigit() else c for c in seen[len(lead):])
    return new


def titled(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Entities by their own form, and names after titles."""
    for m in PATTERN.finditer(text):
        kind = m.lastgroup
        a, b = m.span(kind)
        if kind == "ip" and any(int(p) > 255 for p in m[kind].split(".")):
            continue
        if kind == "ip6":
            try:
                ipaddress.ip_address(m[kind])
            except ValueError:
                continue
            if m[kind] == "::":
                continue
        if kind == "name":
            genders = [TITLES.get(t) or TITLES[t.removesuffix(".")] for t in text[m.start(): a].split()]
            yield a, b, "name-" + next((g for g in genders if g != "n"), "n"), m[kind]
        else:
            yield a, b, kind, m[kind]


def found(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, text) of the entities, with the bare mentions of names that have a title in the text."""
    seen = list(titled(text))
    known = {}
    # A title without gender takes that of another title of the same name.
    for _, _, kind, t in sorted((x for x in seen if x[2][:4] == "name"), key=lambda x: x[2] == "name-n"):
        kind = next((known[w] for w in t.split(" ") if w in known), kind) if kind == "name-n" else kind
        for w in t.split(" "):
            known.setdefault(w, kind)
    if not known:
        return seen
    out, at = [], 0
    for start, end, kind, t in [*seen, (len(text), len(text), "", "")]:
        for m in WORD.finditer(text, at, start):
            gender = known.get(m[0])
            if gender and out and out[-1][1] == m.start() - 1 >= at and text[out[-1][1]] == " " and out[-1][2] == gender:
                out[-1] = (out[-1][0], m.end(), gender, text[out[-1][0]: m.end()])
            elif gender:
                out.append((m.start(), m.end(), gender, m[0]))
        if kind:
            out.append((start, end, known[t.split(" ")[0]] if kind == "name-n" else kind, t))
        at = end
    return out


def parts_of(kind: str, text: str) -> list[str]:
    """What draws a surrogate of its own: each word of a name."""
    return text.split(" ") if kind[:4] == "name" else [text]


CLUE = np.zeros(256, dtype=bool)
CLUE[[*range(48, 58), 64, 61, 58, 34, 39]] = True


def suspects(batch: pa.RecordBatch) -> np.ndarray:
    """Rows whose text may hold an entity: cheap tests before the patterns."""
    from tidemark.llm.minhash import text_slices

    out = np.zeros(batch.num_rows, dtype=bool)
    for a, b, data, bounds in text_slices(batch, "text"):
        before = np.concatenate([[0], np.cumsum(CLUE[data])])
        out[a:b] = before[bounds[1:]] > before[bounds[:-1]]
    for k in np.flatnonzero(~out):
        text = batch.column("text")[int(k)].as_py()
        out[k] = bool(text) and any(t in text for t in TITLE_WORDS)
    return out


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = set()
        for k in np.flatnonzero(suspects(batch)):
            doc_id, text = batch.column("doc_id")[int(k)].as_py(), batch.column("text")[int(k)].as_py()
            rows |= {(doc_id, kind, canonical(kind, p)) for _, _, kind, t in found(text) for p in parts_of(kind, t)}
        if rows:
            ids, kinds, names = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds), pa.array(names)], names=["doc_id", "kind", "entity"])


def _draw(key: str, attempt: int):
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(key, k, e, attempt) for k, e in zip(b.column("kind").to_pylist(), b.column("entity").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("entity"), pa.array(new, pa.string()),
                                              pa.array([attempt] * len(new), pa.int32())], names=["kind", "entity", "surrogate", "attempt"])

    return draw


ROUNDS = 48  # draws of an entity whose space is finite
GROWING = ("name-m", "name-f", "name-n", "email", "password")


def shape(kind: str, entity: str) -> str:
    """What entities have in common whose surrogates may be exchanged."""
    form = re.sub(r"\d", "0", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", entity))
    if kind == "card":
        return f"{entity[0]}{form}{luhn(entity) == 0}"
    if kind == "phone":
        return entity.partition("|")[0] + form
    return entity[:2] + form if kind == "iban" else form


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        of = [shape(k, e) for k, e in zip(b.column("kind").to_pylist(), b.column("entity").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("entity"), pa.array(of, pa.string())], names=["kind", "entity", "shape"])


def next_of_shape(open_: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate, attempt): each open entity's successor among all of its kind and shape."""
    schema = "kind string, entity string, shape string"
    crowded = open_.mapInArrow(_shapes, schema).select("kind", "shape").distinct()
    rows = names.mapInArrow(_shapes, schema).join(crowded, ["kind", "shape"], "left_semi")
    placed = ordered_rank(rows, [F.col("kind"), F.col("shape"), F.md5(F.concat(F.lit(key), F.col("entity"))), F.col("entity")])
    first = placed.groupBy("kind", "shape").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    after = placed.join(first, ["kind", "shape"]).select(
        "kind", "shape", "entity", (F.col("first") + (F.col("rank") - F.col("first") + 1) % F.col("n")).alias("rank"))
    return after.join(placed.select("kind", "shape", "rank", F.col("entity").alias("surrogate")), ["kind", "shape", "rank"]) \
        .join(open_, ["kind", "entity"], "left_semi").select("kind", "entity", "surrogate", F.lit(ROUNDS).alias("attempt"))


def distinct_surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, entity, surrogate, attempt) with no two entities of a kind sharing a surrogate and none that occurs,
    but for entities of crowded shapes (attempt ``ROUNDS``), whose surrogate is another entity's name."""
    names = settle(entities.select("kind", "entity").distinct())
    schema = "kind string, entity string, surrogate string, attempt int"
    fixed, open_, attempt = None, names, 0
    while True:
        drawn = settle(open_.mapInArrow(_draw(key, attempt), schema))
        best = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        good = drawn.join(best, ["kind", "surrogate", "entity"], "left_semi") \
            .join(names.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if fixed is not None:
            good = good.join(fixed.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = settle(good.select("kind", "entity", "surrogate", "attempt"))
        fixed = good if fixed is None else settle(fixed.unionAll(good))
        open_ = settle(drawn.join(good, ["kind", "entity"], "left_anti").select("kind", "entity"))
        attempt += 1
        if attempt == ROUNDS:
            finite = ~F.col("kind").isin(*GROWING)
            fixed = settle(fixed.unionAll(next_of_shape(open_.filter(finite), names, key)))
            open_ = settle(open_.filter(~finite))
        if open_.isEmpty():
            return fixed


def _replace(key: str):
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = b.column("text").to_pylist(), np.zeros(b.num_rows, dtype=np.int32)
            for k in np.flatnonzero(suspects(b)):
                again = b.column("again")[int(k)].as_py()
                again = {(x["kind"], x["entity"]): x["surrogate"] for x in json.loads(again)} if again else {}
                text, out, at = texts[k], [], 0
                for start, end, kind, seen in found(text):
                    new = []
                    for part in parts_of(kind, seen):
                        entity = canonical(kind, part)
                        new.append(render(kind, part, again.get((kind, entity)) or surrogate(key, kind, entity, 0)))
                    out += [text[at:start], " ".join(new)]
                    at = end
                    counts[k] += 1
                texts[k] = "".join([*out, text[at:]])
            size = [None if t is None else len(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(texts, pa.string()), pa.array(counts), pa.array(size, pa.int64())],
                names=["row", "text", "n_entities", "chars"])

    return replace


def replace_personal_data(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``; personal data are found twice rather than texts shuffled.

    Surrogates beyond the first draw are rare; only they are joined to their documents.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = settle(rows.mapInArrow(_entities, "doc_id long, kind string, entity string"))
    later = distinct_surrogates(seen, key).filter("attempt > 0").select("kind", "entity", "surrogate")
    again = settle(seen.join(later, ["kind", "entity"]).groupBy("doc_id").agg(
        F.to_json(F.collect_set(F.struct("kind", "entity", "surrogate"))).alias("again")))
    others = [c for c in docs.columns if c not in ("text", "n_entities")]
    row = F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")
    kind = docs.select(row).schema["row"].dataType.simpleString()
    base = docs.select(F.col("doc_id").cast("long").alias("_id"), row, "text")
    if again.isEmpty():
        joined = base.withColumn("again", F.lit(None).cast("string"))
    else:
        joined = base.join(again, F.col("_id").eqNullSafe(F.col("doc_id")), "left")
    done = joined.select("row", "text", "again").mapInArrow(_replace(key), f"row {kind}, text string, n_entities int, chars long")
    at = docs.columns
    picked = [F.col("text") if c == "text" else F.col("chars").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
              for c in at if c != "n_entities"]
    return done.select(*picked, "n_entities")
