"""Personal data replaced by keyed surrogates of the same type and format.

Every replacement is a keyed permutation, so it needs no table to share:
distinct entities stay distinct over the whole corpus and one entity has one
surrogate everywhere.

Structured entities (mail addresses, phone and card numbers, network addresses,
social security and account numbers, access keys, secrets) are moved by a
Feistel network over exactly the strings of their format, conjugated with a
cyclic shift, which leaves no string where it was. What formatting does not
change about an entity (case of a mail address, blanks in a number) does not
change its surrogate. Country codes stay, and the check digits of cards and
account numbers keep their state, right or wrong.

Names are found after titles, which may stack, after initials and particles,
and as a common given name before a capitalised word. Every other capitalised
whole-word mention in the document, in whatever case, is the same name. A name
becomes a pronounceable one: its letters' rank among all names of its script is
permuted and spelt in syllables, with an ending that shows the gender of given
names. Hyphens, apostrophes, initials, particles and capitals stay as they are.
A surrogate that is itself a name or a capitalised word of the document is
drawn again. So a name's surrogate depends on key, name and kind (given name of
a man or woman, other) alone, but for such a clash.

Null texts stay null with no entity; texts without entities stay as they are,
byte for byte. Repeated rows are treated alike. Null ids and extra columns need
no care: every column but the text is passed through, and an input column
named __entities gives way to the array of that name where it is asked for.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: For tests and the registered queries; whoever replaces real data passes a secret of their own.
DEMO_KEY = "wayfold-demo-key"
ROUNDS = 6
#: Characters that are permuted together; longer entities are permuted in parts, each keyed by those before it.
PART = 48
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
GREEK = "αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋΐΰ"
#: Latin letters beyond a to z that names of European languages hold.
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßāăąćčďđēėęěğģīįıķļłńņňōőœŕřśşšţťūůűųźżžșț"
#: Those of them with one capital each; structured values permute them within their case. ß, which has none, stays.
ACCENTED_LOWER = "".join(c for c in ACCENTED if len(c.upper()) == 1 and c.upper().lower() == c)
ACCENTED_UPPER = ACCENTED_LOWER.upper()

# Titles by gender, particles of family names, common given names.
TITLES = {"m": "Mr Mister Herr Señor Sr Monsieur Don Sir".split(), "f": "Mrs Ms Miss Frau Señora Sra Madame Mme Doña Lady Dame".split(), "n": "Dr Prof Professor Doctor Doktor".split()}
#: Titles that go with a given name when one name follows.
GIVEN_TITLES = "Don Doña Sir Lady Dame Miss".split()
PARTICLES = "de del della di da dos das du la le van von der den ter ten zu zur al bin ibn".split()
GIVEN = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Paul Andrew Kevin Brian George Edward Peter Henry Juan José Carlos Luis Miguel Pedro Javier Hans Klaus Jürgen Wolfgang Heinrich Pierre Jacques François Philippe Antoine".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Margaret Emily Michelle Laura Anna Rebecca Helen Maria María Carmen Isabel Lucía Ursula Sabine Monika Gisela Ingrid Heike Françoise Monique Nathalie Sylvie Brigitte Céline Élodie".split(),
}
# Country calling codes of two digits; 1 and 7 have one digit, all others three.
CALLING_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

#: Syllables by script, and by kind of name the ending of a name spelt in plain letters, in accented ones, in others.
SYLLABLES = {
    "latin": [a + b for a in "b d f g h k l m n p r s t v w j".split() for b in "aeiou"],
    "cyrillic": [a + b for a in "б в г д ж з к л м н п р с т ф х".split() for b in "аеиоу"],
    "greek": [a + b for a in "β γ δ ζ θ κ λ μ ν π ρ τ φ χ".split() for b in "αειου"],
}
ENDINGS = {
    "latin": {"m": ("n", "s", "x"), "f": ("na", "sa", "xa"), "n": ("r", "l", "m")},
    "cyrillic": {"m": ("н", "с", "ш"), "f": ("ня", "ся", "шя"), "n": ("р", "л", "м")},
    "greek": {"m": ("ς", "ρ", "ξ"), "f": ("νη", "ρη", "ξη"), "n": ("ν", "λ", "μ")},
}

_LETTER = r"[^\W\d_]"
_NAME = rf"(?:[DO]['’])?{_LETTER}{{2,}}(?:[-'’]{_LETTER}{{2,}})*"
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
#: Don is a given name too: it goes with another title only after Señor.
_STACKED = "|".join(t for t in _TITLE.split("|") if t != "Don")
#: So many more at once: a match begins at every title, so longer rows of them are met from a later one.
_MORE = rf"(?: +(?:{_STACKED})\.?(?= )|(?:(?<=Señor)|(?<=Sr)|(?<=Sr\.)) +Don(?= )){{0,6}}"
_INITIALS = r"(?:[^\W\d_a-z]\.[ -]*|[^\W\d_a-z] +)*"
_PARTICLES = rf"(?:(?i:{'|'.join(PARTICLES)}) +)*"
_GIVEN = "|".join(sorted((g for gs in GIVEN.values() for g in gs), key=len, reverse=True))
#: What names a secret, and one without quotes: up to the next blank, but for closing punctuation. After a colon or
#: blanks it needs a digit or a symbol, since plain words may follow there.
_LABEL = r"(?i:passwor[dt]|passwd|pwd|secret|token|contraseña|api[_-]?key|access[_-]?key)(?:[_-]\w{1,40})?"
_VALUE = r"[^\s\"'<>]{5,}[^\s\"'<>.,;:)\]}]"
#: What follows a given name in names of places.
_PLACES = "Street|St|Road|Rd|Avenue|Ave|Lane|Square|Bridge|Park|Hall|Station|Airport|University|Straße|Platz|Allee|Brücke"
#: Types in the order in which they claim text.
PATTERNS = [
    ("secret", r"(?<=://)[^\s/:@]{1,256}:([^\s/@]+)(?=@)"),
    ("email", r"(?<![\w.+-])[^\W_][\w.+-]*@[^\W_](?:[^\W_]|-){0,62}(?:\.(?:[^\W_]|-){1,63}){1,8}(?![\w-])"),
    ("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("secret", rf"{_LABEL}[\"']?\s{{0,3}}[=:]\s{{0,3}}(?:\"([^\"\n]{{4,}})\"|'([^'\n]{{4,}})')"),
    ("secret", rf"{_LABEL}[\"']?(?:=|\s{{0,3}}[=:]\s{{0,3}}(?=\S*[^\W\d_]*[\d!#$%&*+/@^_=~-]\S))({_VALUE})"),
    ("secret", r"(?<!\w)(?i:bearer) +([A-Za-z0-9._~+/=-]{16,})"),
    ("secret", r"(?<!\w)(?:gh[pousr]_|github_pat_|glpat-|sk-|xox[abprs]-)([A-Za-z0-9_.-]*[A-Za-z0-9_-]{10,})"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w+(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}([ .-])\d{3}\1\d{4}(?![\w-])|(?<![\w.+-])0\d{2,4}[ /-]\d{6,8}(?![\w-])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)"),
    ("card", r"(?<![\w-])(?:[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\w-])"),
    ("name", rf"(?<!\w)(?P<title>(?:{_TITLE})\.?{_MORE}) +{_INITIALS}{_PARTICLES}(?P<given>(?!(?:{_STACKED})\.? ){_NAME})(?: +{_INITIALS}{_PARTICLES}(?P<family>{_NAME}))?"),
    ("name", rf"(?<!\w)(?P<given>{_GIVEN})(?: +{_INITIALS}{_PARTICLES}(?P<family>(?!(?:{_PLACES})\b){_NAME})(?!\w))(?! +(?:{_PLACES})\b)"),
]
COMPILED = [(kind, re.compile(p)) for kind, p in PATTERNS]
HINT = re.compile(rf"[0-9@]|[=:]|(?i:bearer )|gh[pousr]_|github_pat_|glpat-|sk-|xox|(?<!\w)(?:(?:{_TITLE})\.? |(?:{_GIVEN}) )")
WORD = re.compile(rf"(?<!\w){_NAME}(?!\w)")


class Entity(NamedTuple):
    start: int
    end: int
    kind: str
    value: str
    surrogate: str


def luhn(digits: str) -> int:
    """The check digit of a number without it."""
    total = 0
    for place, d in enumerate(reversed(digits)):
        x = int(d) * (2 - place % 2)
        total += x - 9 * (x > 9)
    return -total % 10


def iban_check(country: str, body: str) -> int:
    """The two check digits of an account number, 2 to 98."""
    spelt = "".join(str(int(c, 36)) for c in f"{body}{country}00")
    return 98 - int(spelt) % 97


class Surrogates:
    """Keyed replacements; one instance serves any number of documents."""

    def __init__(self, key: str):
        if not key:
            raise ValueError("surrogates need a key")
        self.key = hashlib.sha256(key.encode()).digest()
        self.known: dict[tuple[str, str], str] = {}

    def draw(self, bits: int, *parts: str | int) -> int:
        """So many bits that the key and the parts decide."""
        text = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
        return int.from_bytes(hashlib.shake_256(self.key + text).digest(-(-bits // 8)), "big") & ((1 << bits) - 1)

    def network(self, value: int, size: int, tweak: str, rounds: range) -> int:
        """A keyed permutation of range(size); rounds in reverse invert it."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        back = rounds.step < 0
        while True:
            left, right = value >> half, value & mask
            for k in rounds:
                if back:
                    left, right = right ^ self.draw(half, tweak, size, k, left), left
                else:
                    left, right = right, left ^ self.draw(half, tweak, size, k, right)
            value = left << half | right
            if value < size:
                return value

    def permute(self, value: int, size: int, tweak: str) -> int:
        """A keyed permutation of range(size) that moves every value, if there are two."""
        if size < 2:
            return value
        shift = 1 + self.draw(size.bit_length() + 64, tweak, size, "shift") % (size - 1)
        moved = (self.network(value, size, tweak, range(ROUNDS)) + shift) % size
        return self.network(moved, size, tweak, range(ROUNDS - 1, -1, -1))

    def inject(self, value: int, size: int, tweak: str) -> int:
        return self.network(value, size, tweak, range(ROUNDS)) if size > 1 else value

    def reshape(self, text: str, tweak: str, hexadecimal: bool = False) -> str:
        """text with every letter and digit permuted within its class; other characters stay."""
        classes = (HEX,) if hexadecimal else (DIGITS, LOWER, UPPER, CYRILLIC, CYRILLIC.upper(), GREEK, ACCENTED_LOWER, ACCENTED_UPPER)
        places = [(p, a) for p, c in enumerate(text) if (a := next((a for a in classes if c in a), None))]
        shape = "".join("0" if a is DIGITS else "a" if a is LOWER else "A" if a is UPPER else "x" for _, a in places)
        out, before = list(text), ""
        for begin in range(0, len(places), PART):
            part, value, size = places[begin : begin + PART], 0, 1
            for place, alphabet in part:
                value, size = value * len(alphabet) + alphabet.index(text[place]), size * len(alphabet)
            moved = self.permute(value, size, f"{tweak}:{shape if len(shape) <= PART else len(shape)}:{shape[begin : begin + PART]}:{before}")
            for place, alphabet in reversed(part):
                moved, digit = divmod(moved, len(alphabet))
                out[place] = alphabet[digit]
            before = hashlib.sha256(f"{before}{text[part[0][0] : part[-1][0] + 1]}".encode("utf-8", "surrogatepass")).hexdigest()
        return "".join(out)

    def structured(self, kind: str, value: str) -> str:
        if kind == "email":
            local, _, domain = "".join(c.lower() if len(c.lower()) == 1 else c for c in value).partition("@")
            top = domain.rfind(".")
            fresh = f"{self.reshape(local, 'local')}@{self.reshape(domain[:top], 'domain')}{domain[top:]}"
            return "".join(f.upper() if v.isupper() and len(f.upper()) == 1 else f for f, v in zip(fresh, value, strict=True))
        if kind == "access_key":
            return value[:4] + self.reshape(value[4:], kind)
        if kind == "ip":
            own = ipaddress.ip_address(value)
            moved = self.permute(int(own), 1 << own.max_prefixlen, f"ip{own.version}")
            fresh = str(type(own)(moved))
            return fresh.upper() if value.upper() == value and value.lower() != value else fresh
        if kind == "secret":
            return self.reshape(value, kind, bool(re.fullmatch(r"[0-9a-f]+", value)))
        bare = re.sub(r"[ ().+-]", "", value)
        if kind == "card":
            body = bare[0] + self.reshape(bare[1:-1], f"card{bare[0]}")
            bare_fresh = body + str((luhn(body) + int(bare[-1]) - luhn(bare[:-1])) % 10)
        elif kind == "iban":
            country, body = bare[:2], self.reshape(bare[4:], f"iban{bare[:2]}")
            off = int(bare[2:4]) - iban_check(country, bare[4:])
            bare_fresh = f"{country}{(iban_check(country, body) + off) % 100:02d}{body}"
        elif kind == "phone":
            code = 0 if value[0] != "+" else 1 if bare[0] in "17" else 2 if bare[:2] in CALLING_CODES else 3
            bare_fresh = bare[:code] + self.reshape(bare[code:], f"phone{bare[:code]}")
        else:
            bare_fresh = self.reshape(bare, kind)
        fresh = iter(bare_fresh)
        return "".join(next(fresh) if c.isalnum() else c for c in value)

    def spelt(self, folded: str, kind: str, tries: int) -> str:
        """The surrogate of a part of a name, in lower case. kind: m, f or n."""
        script = "cyrillic" if re.search(r"[Ѐ-ӿ]", folded) else "greek" if re.search(r"[Ͱ-Ͽἀ-῿]", folded) else "latin"
        plain = {"latin": LOWER, "cyrillic": CYRILLIC, "greek": GREEK}[script]
        alphabets = [plain, plain + ACCENTED]
        level = next((k for k, a in enumerate(alphabets) if all(c in a for c in folded)), 2)
        base = len(alphabets[level]) if level < 2 else 0x110000
        rank = 0
        for c in folded:  # the place among all strings, shorter ones first
            rank = rank * base + (alphabets[level].index(c) if level < 2 else ord(c)) + 1
        known, count, size = SYLLABLES[script], 2, len(SYLLABLES[script]) ** 2
        while rank >= size:  # each number of syllables takes the ranks that it can hold
            rank, count, size = rank - size, count + 1, size * len(known)
        moved, out = self.inject(rank, size, f"name:{script}:{kind}:{level}:{tries}"), ""
        for _ in range(count):
            moved, digit = divmod(moved, len(known))
            out = known[digit] + out
        return out + ENDINGS[script][kind][level]

    def name(self, folded: str, kind: str, taken: set[str] = frozenset()) -> str:
        """The surrogate of a case-folded name; not one of taken."""
        for tries in range(len(taken) + 2):
            parts = re.split(r"([-'’])", folded)
            fresh = "".join(self.spelt(p, kind, tries) if len(p) > 1 else p for p in parts)
            if fresh not in taken and fresh != folded:
                break
        return fresh


def in_case_of(fresh: str, like: str) -> str:
    """fresh with the capitals of a name: all of them, or those that begin its parts."""
    if like.isupper():
        return fresh.upper()
    begins = [p[:1].isupper() for p in re.split(r"[-'’]", like)]
    parts = re.split(r"([-'’])", fresh)
    return "".join(p if k % 2 or not begins[k // 2] else p[:1].upper() + p[1:] for k, p in enumerate(parts))


def valid(kind: str, value: str) -> bool:
    if kind == "ip":
        try:
            ipaddress.ip_address(value)
        except ValueError:
            return False
        return any(c.isdigit() for c in value)
    return kind != "secret" or any(c.isalnum() for c in value)


def named_parts(m: re.Match) -> Iterator[tuple[str, str]]:
    """(group, kind) of the names of a match: m or f for given names of known gender, else n."""
    titles = re.findall(r"\w+", m.groupdict().get("title") or "")
    gender = next((g for t in titles for g in "mf" if t in TITLES[g]), None) or next((g for g in "mf" if m["given"] in GIVEN[g]), "n")
    both = bool(m["family"] and m["family"][0].isupper())
    if m["given"][0].isupper() and (titles or both):
        yield "given", gender if both or titles and titles[-1] in GIVEN_TITLES else "n"
        if both:
            yield "family", "n"


def detect(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, value, gender) of entities, without overlaps, in order."""
    if not HINT.search(text):
        return []
    found: list[tuple[int, int, str, str, str]] = []
    used = bytearray(len(text))

    def claim(start: int, end: int, kind: str, gender: str = "") -> None:
        if not any(used[start:end]):
            used[start:end] = b"\x01" * (end - start)
            found.append((start, end, kind, text[start:end], gender))

    for kind, pattern in COMPILED:
        for m in pattern.finditer(text):
            if kind == "name":
                for part, gender in named_parts(m):
                    claim(*m.span(part), kind, gender)
            else:
                group = m.lastindex if kind == "secret" else 0
                if valid(kind, m[group]):
                    claim(*m.span(group), kind)
    names: dict[str, str] = {}
    for _, _, kind, value, gender in sorted(found):
        if kind == "name":
            folded = value.casefold()
            for name in {folded, *(p for p in re.split(r"[-'’]", folded) if len(p) > 1)}:
                if names.get(name, "n") == "n":
                    names[name] = gender
    if names:
        for m in WORD.finditer(text):
            if m[0][0].isupper():
                if m[0].casefold() in names:
                    claim(*m.span(), "name")
                else:  # a name may be part of a hyphenated word
                    for part in re.finditer(rf"{_LETTER}{{2,}}", m[0]):
                        if part[0][0].isupper() and part[0].casefold() in names:
                            claim(m.start() + part.start(), m.start() + part.end(), "name")
    return sorted((a, b, k, v, names[v.casefold()] if k == "name" else g) for a, b, k, v, g in found)


def anonymise(text: str, keyed: Surrogates) -> tuple[str, list[Entity]]:
    """The text with surrogates, and the entities replaced."""
    spans = detect(text)
    if not spans:
        return text, []
    names: dict[str, str] = {}
    if any(kind == "name" for _, _, kind, _, _ in spans):
        taken = {m[0].casefold() for m in WORD.finditer(text) if m[0][0].isupper()}
        for _, _, kind, value, gender in spans:
            folded = value.casefold()
            if kind == "name" and folded not in names:
                names[folded] = keyed.name(folded, gender, taken)
                taken.add(names[folded])
    entities, parts, at = [], [], 0
    for start, end, kind, value, _ in spans:
        fresh = in_case_of(names[value.casefold()], value) if kind == "name" else keyed.structured(kind, value)
        parts += [text[at:start], fresh]
        at = end
        entities.append(Entity(start, end, kind, value, fresh))
    return "".join(parts) + text[at:], entities


def replace_documents(docs: DataFrame, key: str, text_col: str = "text", with_entities: bool = False) -> DataFrame:
    """docs with surrogates in the text and, if asked for, an array column __entities."""
    Surrogates(key)
    if with_entities:
        docs = docs.drop("__entities")
    schema = T.StructType([f if f.name != text_col else T.StructField(f.name, T.StringType()) for f in docs.schema])
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("surrogate", T.StringType())]))
    if with_entities:
        schema = schema.add("__entities", kind)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Surrogates(key)
        for batch in batches:
            texts, all_entities = [], []
            for value in batch.column(column):
                text = value.as_py()
                fresh, entities = (None, []) if text is None else anonymise(text, keyed)
                texts.append(fresh)
                all_entities.append([e._asdict() for e in entities])
            columns = [*batch.columns]
            columns[column] = pa.array(texts, pa.string())
            names = [*batch.schema.names]
            if with_entities:
                row = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("surrogate", pa.string())])
                columns.append(pa.array(all_entities, pa.list_(row)))
                names.append("__entities")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)
