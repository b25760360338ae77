"""Personal data replaced by keyed surrogates.

Detected entities: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment card numbers (Luhn or 16 digits), IBANs,
US social security numbers, secrets (long hexadecimal strings, and values behind a key-like name), and names of
persons behind a title or beginning with a known given name. Each gets a surrogate made from an HMAC of a secret key,
the entity's type and its canonical form, so an entity has one surrogate in all documents (coreference), whatever its
spelling of case or separators and whatever title stands before it. A surrogate keeps type and format: letters stay
letters of the same script and case, digits digits, separators stay; a card keeps its validity, an address's octets
stay valid, an e-mail its last domain label, a name its gender and its number of words. A part of a name has one surrogate in
all names ("Maria Weber", "Dr. J. Weber", "Weber's"), except where telling two names apart needs another.

A name's gender is that of its given name if known, else what its titles say in the whole corpus (where they
contradict each other, "f"): it goes with the entity, not with the mention.

Distinctness is checked over the whole corpus: entities are collected, and where two share a surrogate, or one is
a real entity, all but the first take the next attempt, until none is left. From the ``WIDEN``-th attempt on a surrogate
gets longer by one sign for each further attempt (an address of four octets becomes one of eight groups), so that a
space too small for its entities, such as names of one letter, never runs out. What is checked is what is written:
entities whose surrogate isn't that of their first attempt and default gender travel to the texts, broadcast up to
``BROADCAST_RETRIES`` and joined by text beyond.

Defined cases: a null text stays null with 0 entities, an empty one empty; repeated rows are rewritten alike; an
empty table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import materialize, ship

BROADCAST_RETRIES = 100_000
#: The attempt from which surrogates get longer.
WIDEN = 3

# Given names by gender and script, and titles by gender.
GIVEN = {
    ("f", "LATIN"): (
        "Mary Anna Emma Julia Laura Sarah Alice Clara Elena Sofia Marta Nina Paula Rosa Irene Helen Ruth Eva Lucia Nora Jennifer Jessica Elizabeth Patricia Linda Susan Karen Nancy Lisa Margaret Sandra Ashley"
        " Kimberly Emily Michelle Amanda Melissa Rebecca Stephanie Fatima Aisha Maria Olivia Isabella Charlotte Amelia Hannah Katharina Johanna Camille Chloe Giulia Francesca Carmen Pilar"
    ).split(),
    ("m", "LATIN"): (
        "John Paul Peter Martin David Thomas Daniel Mark Hugo Oscar Felix Simon Victor Albert Jonas Marco Luis Henry George Robert James Michael William Richard Joseph Charles Christopher Matthew Anthony Steven"
        " Andrew Kenneth Kevin Brian Edward Ronald Timothy Jason Mohammed Muhammad Ahmed Ali Omar Carlos Juan Pedro Pierre Jean Hans Klaus Wolfgang Giovanni Luca Matteo"
    ).split(),
    ("f", "CYRILLIC"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Вера Нина".split(),
    ("m", "CYRILLIC"): "Иван Пётр Павел Андрей Сергей Николай Дмитрий Алексей Михаил Виктор".split(),
    ("f", "GREEK"): "Μαρία Ελένη Άννα Σοφία Κατερίνα".split(),
    ("m", "GREEK"): "Γιώργος Νίκος Πέτρος Ανδρέας Κώστας".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Mme Madame Mlle Señora Sra Doña Signora".split(), "m": "Mr Herr Monsieur Señor Sr Don Signor".split(), "n": "Dr Prof Dra Professor".split()}
_BY_NAME = {n: key for key, names in GIVEN.items() for n in names}
# a possessive's 's is no part of a name; an initial with its full stop is, in front of more of it
_NAME = r"[^\W\d_a-zà-ÿ]\w*(?:['’-](?!s\b)\w+)*"
_INITIALS = r"(?:[^\W\d_a-zà-ÿ]\.[ \t]*)*"
_PERSON = re.compile(rf"\b(?:(?P<title>{'|'.join(sorted(sum(TITLES.values(), []), key=len, reverse=True))})\.?[ \t]+(?P<titled>{_INITIALS}{_NAME}(?:[ \t]+{_INITIALS}{_NAME}){{0,2}})|(?P<given>(?:{'|'.join(_BY_NAME)})(?:[ \t]+{_INITIALS}{_NAME}){{1,2}})\b)")
_TITLE_GENDER = {t: g for g, titles in TITLES.items() for t in titles}
# Order matters: at the same place the first that fits is taken.
_PATTERNS = {
    "email": re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}"),
    "secret": re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:ghp|gho|sk|pk|xox[abp])[-_][0-9A-Za-z_-]{16,})(?![0-9A-Za-z])"),
    "keyed": re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth)\b[\"']?\s*[:=]\s*[\"']?(?P<value>[^\s\"',;]{6,})"),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,4})?\b"),
    "ip": re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    "ip6": re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![\w:])"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "card": re.compile(r"(?<![\d.])(?:\d{4}[ -]){3}\d{4}(?!\d)|(?<![\d.])\d{13,19}(?!\d)"),
    # between a phone number's parts up to five other signs may stand
    "phone": re.compile(r"(?<!\w)(?:\+\d{1,3}\W{0,5})?\(\d{2,4}\)\W{0,5}\d{3,4}[ .-]\d{3,4}(?!\w)|(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<!\w)\+\d{8,14}(?!\d)|(?<![\w.+-])[2-9]\d{2}[2-9]\d{6}(?![\w-]|\.\d)"),
}
_CASELESS = {"email", "iban", "name", "ip"}


def gender_of(name: str) -> str:
    """f or m if the name begins with a known given name, else empty."""
    return _BY_NAME.get(name.split()[0].capitalize(), ("",))[0]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _address(value: str) -> bool:
    """Whether it is an IPv6 address, and no scope operator between short names."""
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return any(c.isdigit() for c in value) and sum(c != ":" for c in value) >= 4


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, detail) of each entity, in order, without overlaps; detail is a name's gender."""
    found: list[tuple[int, int, int, str, str]] = []
    some_digit = any(d in text for d in "0123456789")
    for rank, (kind, pattern) in enumerate(_PATTERNS.items()):
        if kind == "email" and "@" not in text or kind == "ip6" and ":" not in text or kind not in ("email", "secret", "keyed") and not some_digit or kind == "keyed" and "=" not in text and ":" not in text:
            continue
        for m in pattern.finditer(text):
            a, b = m.span("value") if kind == "keyed" else m.span()
            if kind == "card" and len(digits := re.sub(r"\D", "", m[0])) != 16 and not luhn(digits):
                continue
            if kind == "ip6" and not _address(m[0]):
                continue
            found.append((a, -b, rank, {"keyed": "secret", "ip6": "ip"}.get(kind, kind), ""))
    for m in _PERSON.finditer(text):
        which = "titled" if m["titled"] else "given"
        found.append((m.start(which), -m.end(which), 99, "name", gender_of(m[which]) or _TITLE_GENDER.get(m["title"] or "", "n")))
    out: list[tuple[int, int, str, str]] = []
    for a, b, _, kind, detail in sorted(found):
        if not out or a >= out[-1][1]:
            out.append((a, -b, kind, detail))
    return out


def canonical(kind: str, value: str) -> str:
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "phone":
        return ("+" if value.startswith("+") else "") + re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    return " ".join(value.split()).lower() if kind in _CASELESS else value


class _Stream:
    """Numbers from an HMAC: the same for the same key and message."""

    def __init__(self, key: bytes, message: str):
        self.key, self.message, self.block, self.left = key, message.encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hmac.new(self.key, self.message + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        v, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return v % n


_LETTERS = {"LATIN": ("aeiou", "bcdfghklmnprstvw"), "CYRILLIC": ("аеиоуы", "бвгдзклмнпрст"), "GREEK": ("αειου", "βγδζκλμνπρστ")}


def script(char: str) -> str:
    return unicodedata.name(char, "LATIN").split(" ")[0]


def _letters(word: str, s: _Stream, hexadecimal: bool = False) -> str:
    """Each letter by one of its script and case, vowels and consonants in turn; each digit by a digit."""
    out, turn = [], s.below(2)
    for c in word:
        if c.isdigit():
            out.append(str(s.below(10)) if not hexadecimal else "0123456789abcdef"[s.below(16)])
        elif c.isalpha():
            if hexadecimal:
                new = "0123456789abcdef"[s.below(16)]
            elif (kind := script(c)) in _LETTERS:
                pool = _LETTERS[kind][turn]
                new = pool[s.below(len(pool))]
                turn = 1 - turn
            else:  # other scripts: a letter nearby of the same script
                new = next((x for x in (chr(ord(c) - 20 + s.below(41)) for _ in range(40)) if x.isalpha() and script(x) == kind), c)
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def core(kind: str, gender: str, canon: str, attempt: int, key: bytes) -> str:
    """The surrogate's canonical form; ``gender`` is the entity's, not a mention's."""
    s = _Stream(key, f"{kind}\x00{canon}\x00{attempt}")
    extra = max(0, attempt - WIDEN + 1)
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels = domain.split(".")
        # equal domains stay equal, whoever writes from them
        d = _Stream(key, f"domain\x00{domain}")
        return _letters(local + "e" * extra, s) + "@" + ".".join([*(_letters(x, d) for x in labels[:-1]), labels[-1]])
    if kind == "ip":
        if ":" in canon and not extra:
            return _letters(canon, s, True)
        if extra:
            return ":".join(["fd00", *(f"{s.below(65536):04x}" for _ in range(7))])
        first = int(canon.split(".")[0])
        return ".".join([str(first if first in (10, 127) else 1 + s.below(223)), *(str(s.below(256)) for _ in range(2)), str(1 + s.below(254))])
    if kind == "card":
        body = [str(1 + s.below(9)), *(str(s.below(10)) for _ in range(len(canon) - 2 + extra))]
        check = next(d for d in "0123456789" if luhn("".join(body) + d))
        return "".join(body) + (check if luhn(canon) else str((int(check) + 1 + s.below(9)) % 10))
    if kind == "phone":
        plus = canon.startswith("+")
        digits = canon[1:] if plus else canon
        keep = len(digits) - 10 if plus and len(digits) > 10 else 0
        return "+" * plus + digits[:keep] + "".join(str(1 + s.below(9) if i == 0 else s.below(10)) for i in range(len(digits) - keep + extra))
    if kind == "ssn":
        return f"{1 + s.below(665):03d}{1 + s.below(99):02d}{1 + s.below(9999):04d}" + "".join(str(s.below(10)) for _ in range(extra))
    if kind == "iban":
        return canon[:2] + _letters(canon[2:] + "0" * extra, s).upper()
    if kind == "secret":
        prefix = m[0] if (m := re.match(r"(?:AKIA|ASIA)|(?:ghp|gho|sk|pk|xox[abp])[-_]", canon)) else ""
        rest = canon[len(prefix) :]
        hexadecimal = bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", rest)) and not rest.isdigit()
        out = _letters(rest + rest[-1:] * extra, s, hexadecimal)
        return prefix + (out.upper() if rest.isupper() else out)
    # a part of a name has the same surrogate in every name, so that the part alone is known again; first attempts vary the given name
    words = canon.split()
    longer = words[-1] + next((c for c in reversed(words[-1]) if c.isalpha()), "a") * extra
    part = lambda w, shown, k: _letters(shown, _Stream(key, f"part\x00{w}\x00{k}"))
    if len(words) == 1:
        return part(words[-1], longer, attempt)
    g = _Stream(key, f"given\x00{words[0]}\x00{attempt}")
    given = GIVEN.get((gender if gender != "n" else "fm"[g.below(2)], script(canon[0])))
    first = part(words[0], words[0], attempt) if words[0].endswith(".") or not given else given[g.below(len(given))].lower()
    return " ".join([first, *(part(w, w, attempt // 6) for w in words[1:-1]), part(words[-1], longer, attempt // 6)])


def _dress(kind: str, made: str, value: str) -> str:
    """The surrogate in the entity's own format: its separators and case."""
    if kind in ("card", "ssn", "phone", "iban"):
        chars = iter(made.removeprefix("+"))
        return "".join([*(next(chars, "") if c.isalnum() else c for c in value), *chars])
    if kind == "email" and value.isupper():
        return made.upper()
    if kind == "name":
        return " ".join(c.upper() if v.isupper() and len(v) > 1 else c[:1].upper() + c[1:] for c, v in zip(made.split(), value.split(), strict=False))
    return made


def rewrite(text: str, key: bytes, known: dict[tuple[str, str], tuple[int, str]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with surrogates, and (type, start, end) of each in the new text; ``known`` tells attempt and gender."""
    out, spans, at, size = [], [], 0, 0
    for a, b, kind, _ in find(text):
        canon = canonical(kind, text[a:b])
        attempt, gender = known.get((kind, canon)) or (0, default_gender(kind, canon))
        new = _dress(kind, core(kind, gender, canon, attempt, key), text[a:b])
        out += [text[at:a], new]
        size += a - at
        spans.append((kind, size, size + len(new)))
        at, size = b, size + len(new)
    return "".join([*out, text[at:]]), spans


def default_gender(kind: str, canon: str) -> str:
    return gender_of(canon) or "n" if kind == "name" else ""


def _entities(docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, canon, gender) of every entity, once."""

    def scan(batches):
        for b in batches:
            seen = {(k, canonical(k, t[x:y]), d) for t in b.column(0).to_pylist() if t for x, y, k, d in find(t)}
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*seen, strict=True)], names=["kind", "canon", "detail"])

    found = docs.select(text_col).mapInArrow(scan, "kind string, canon string, detail string")
    return found.groupBy("kind", "canon").agg(F.min("detail").alias("gender"))  # f before m before n


def resolve(docs: DataFrame, key: bytes, *, text_col: str = "text") -> DataFrame:
    """(kind, canon, gender, attempt, made) of all entities, so that surrogates are distinct and none is an entity."""
    ship(docs.sparkSession)

    def propose(batches):
        for b in batches:
            k, c, g, a = (b.column(i).to_pylist() for i in range(4))
            made = [core(*x, key) for x in zip(k, g, c, a, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=["kind", "canon", "gender", "attempt", "made"])

    known = materialize(_entities(docs, text_col).withColumn("attempt", F.lit(0)), "entities")
    real = known.select(F.col("kind").alias("r_kind"), F.col("canon").alias("r_canon")).hint("merge")  # grows with the data
    while True:
        made = materialize(known.mapInArrow(propose, "kind string, canon string, gender string, attempt int, made string"), "surrogates")
        first = F.row_number().over(Window.partitionBy("kind", "made").orderBy("attempt", "canon"))
        judged = made.withColumn("place", first).join(real, (F.col("kind") == F.col("r_kind")) & (F.col("made") == F.col("r_canon")), "left")
        again = (F.col("place") > 1) | F.col("r_canon").isNotNull()
        judged = materialize(judged.select("kind", "canon", "gender", "attempt", "made", again.alias("again")), "entities")
        if not judged.where("again").limit(1).count():
            return judged.drop("again")
        known = judged.select("kind", "canon", "gender", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))


def pseudonymize(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_entities, entities) for each row: the new text, and type and place of each surrogate in it."""
    spark = docs.sparkSession

    def differs(batches):
        """Entities whose surrogate a mention alone doesn't tell."""
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
            told = [i for i, (k, c, g, a) in enumerate(rows) if a or len(c.split()) > 1 and g != default_gender(k, c)]
            yield b.take(pa.array(told, pa.int64()))

    found = resolve(docs, key, text_col=text_col).select("kind", "canon", "gender", "attempt")
    told = materialize(found.mapInArrow(differs, "kind string, canon string, gender string, attempt int"), "told-entities")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    small = told.limit(BROADCAST_RETRIES + 1).count() <= BROADCAST_RETRIES
    shared = spark.sparkContext.broadcast({(r["kind"], r["canon"]): (r["attempt"], r["gender"]) for r in told.collect()} if small else {})
    if not small:
        rows = _with_told(rows, told)

    def scan(batches):
        for b in batches:
            own = b.column(2).to_pylist() if b.num_columns > 2 else [None] * b.num_rows
            texts, spans = [], []
            for t, extra in zip(b.column(1).to_pylist(), own, strict=True):
                known = shared.value if extra is None else {(e["kind"], e["canon"]): (e["attempt"], e["gender"]) for e in extra}
                new, at = (None, []) if t is None else rewrite(t, key, known)
                texts.append(new)
                spans.append([{"kind": k, "start": x, "end": y} for k, x, y in at])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            cols = [b.column(0), pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "text", "n_entities", "entities"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(scan, f"id {kind}, text string, n_entities long, entities array<struct<kind:string,start:long,end:long>>")
    return out.select(F.col("id").alias(id_col), "text", "n_entities", "entities")


def _with_told(rows: DataFrame, told: DataFrame) -> DataFrame:
    """``rows`` with the ``told`` entities of their own text, joined by the text's digest."""

    def scan(batches):
        for b in batches:
            cols: tuple[list, ...] = ([], [], [])
            for t in b.column(0).to_pylist():
                digest = hashlib.sha256((t or "").encode()).hexdigest()
                for k, c in {(k, canonical(k, t[x:y])) for x, y, k, _ in find(t or "")}:
                    for col, v in zip(cols, (digest, k, c), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["digest", "kind", "canon"])

    uses = rows.select("text").mapInArrow(scan, "digest string, kind string, canon string").distinct()
    hit = uses.join(told, ["kind", "canon"])
    by_text = hit.groupBy("digest").agg(F.collect_list(F.struct("kind", "canon", "attempt", "gender")).alias("told"))
    joined = rows.withColumn("t_digest", F.sha2(F.coalesce("text", F.lit("")), 256)).join(by_text.hint("merge"), F.col("t_digest") == F.col("digest"), "left")
    return joined.select("id", "text", F.coalesce("told", F.expr("array()").cast("array<struct<kind:string,canon:string,attempt:int,gender:string>>")).alias("told"))
