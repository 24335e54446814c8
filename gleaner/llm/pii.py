"""Surrogates for personal data.

Entities are detected in every text; each distinct one gets a keyed surrogate
of its own type and layout: digits stay digits of their script, separators and
case stay, card numbers keep their issuer's digits and whether their check digit
is right, phone numbers their country, private addresses stay private, names
keep gender and script; a given name whose gender isn't known gets one that
doesn't tell it.  A name is taken to its last word, particles between its words
stay; in scripts without case it is what stands beside a title, two words at
most.  One entity has one surrogate in the whole table, however it is written,
and a word of a name has one whatever part of the name it is (``coreference``).
No two entities share one (``distinctness``): candidates that collide with each
other, or with an entity that really occurs, are drawn again, round by round, as
joins.  Where a class of numbers is so full that this doesn't end, those left
are permuted among themselves.

What is joined are the entities, not the texts; only texts with an entity are
moved, once, and the others pass in place.

Edge cases: null texts stay null; empty texts and texts without an entity stay
as they are; repeated rows get equal results; null ids are allowed, as ids take
no part.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import Bloom, bound_batches, cut

# Given names by script and gender, titles by gender.
GIVEN = {
    ("latin", "m"): "adam alan albert andreas anton antonio carlos daniel david diego edward eric felix fernando "
    "frank george hans henri hugo ivan jacques james jan javier john jose juan karl klaus lars louis lucas luis "
    "marco mark martin michael miguel oliver otto pablo paul pedro peter philip pierre robert stefan thomas victor "
    "william".split(),
    ("latin", "f"): "alice amelia ana andrea anna anne barbara carla carmen caroline catherine clara claire daniela "
    "elena elizabeth ella emily emma eva greta hannah helen ingrid irene isabel jane julia karin laura linda lisa "
    "lucia maria marie marta mary monika nina olivia paula petra rosa ruth sara sofia sophie susan teresa ursula "
    "victoria".split(),
    ("latin", "n"): "alex ariel casey charlie dana jamie kim morgan noel quinn robin sacha sam taylor".split(),
    ("cyrillic", "m"): "александр алексей андрей борис виктор дмитрий иван игорь михаил николай олег павел пётр сергей юрий".split(),
    ("cyrillic", "f"): "александра анна вера галина екатерина елена ирина людмила марина мария наталья ольга светлана татьяна юлия".split(),
    ("cyrillic", "n"): "женя саша слава шура".split(),
    ("greek", "m"): "αλέξανδρος ανδρέας γιώργος δημήτρης κώστας μιχάλης νίκος παύλος πέτρος στέφανος".split(),
    ("greek", "f"): "αικατερίνη άννα βασιλική γεωργία δήμητρα ελένη ειρήνη μαρία σοφία χριστίνα".split(),
}
TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Sr Don Պարոն Господин Кύριος Κύριος".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Señorita Sra Doña Տիկին Госпожа Κυρία".split(),
    "": "Dr Prof Professor Dra".split(),
}
# What stands in lower case within a name; ``JOINING`` may also join two people.
PARTICLES = (
    "van von vom zu zum zur der den dem de di da do dos das du des del dela della delle dei degli la le las los lo el al "
    "ul bin ibn ben bint abu ter ten te tot op af av ’t 't y e i"
).split()
JOINING = {"y", "e", "i"}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо ва ве во да де до за зе ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се та те то".split(),
    "greek": "βα βε βο γα δα δε δο κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε τα τε το".split(),
}
ENDINGS = {
    ("latin", "m"): ["n", "r", "s"], ("latin", "f"): ["na", "la", "ra"],
    ("cyrillic", "m"): ["н", "р", "с"], ("cyrillic", "f"): ["на", "ла", "ра"],
    ("greek", "m"): ["νος", "ρης"], ("greek", "f"): ["νη", "ρα"],
    ("latin", "n"): ["ni", "re"], ("cyrillic", "n"): ["ко"], ("greek", "n"): ["νι"],
}
# Titles in scripts without case, behind or before a name, by gender.
BEHIND = {"m": "先生".split(), "f": "女士 小姐 太太".split(), "": "博士 教授 さん 様 氏 씨 님 선생님 박사님 교수님".split()}
BEFORE = {
    "m": "السيد الدكتور الأستاذ מר श्री ბატონი".split(),
    "f": "السيدة الدكتورة الأستاذة גברת גב' श्रीमती कुमारी ქალბატონი".split(),
    "": "ד״ר ד\"ר פרופ' डॉ.".split(),
}
# Common Han surnames; country codes of two digits (1 and 7 have one, others three).
HAN_SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦方白邹孟熊秦邱江尹薛"
)
TWO_DIGITS = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 "
    "92 93 94 95 98"
).split()

_GENDER = {n: (s, g) for (s, g), names in GIVEN.items() for n in names}
_TITLE = {t.lower(): g for g, ts in TITLES.items() for t in ts}
_NAME = r"[^\W\d_][^\W\d_]*(?:['’-][^\W\d_]+)*"
_RE = {
    "email": re.compile(r"[^\W_][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "secret": re.compile(r"(?i:token|secret|password|passwd|api[_-]?key|key)\s*[=:]\s*[\"']?([A-Za-z0-9_\-]{16,})"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ip6": re.compile(
        r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:.])"
    ),
    "ip": re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"),
    "card": re.compile(r"(?<![\d.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\d)"),
    "national": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "phone": re.compile(
        r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{2,4}\) ?\d{3,4}[ .-]?\d{3,4}"
        r"|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"
    ),
}
_WORD = re.compile(_NAME)
_PART = re.compile(r"[^\W\d_]+")
_TITLED = re.compile(rf"(?<!\w)({'|'.join(sorted(_TITLE, key=len, reverse=True))})(\.?[ ]+)(?=\w)", re.IGNORECASE)
# particles, which stay, and the word of a name behind them
_STEP = re.compile(
    rf"((?:(?:{'|'.join(sorted(PARTICLES, key=len, reverse=True))}) |(?:d|l|dell|dall|nell|al|el|ul|ter)['’-])*)({_NAME})"
)
_LUHN = str.maketrans("0123456789", "0246813579")


@cache
def _script(c: str) -> str:
    name = unicodedata.name(c, "latin").split()[0].lower()
    return "han" if name == "cjk" else name


def script_of(name: str) -> str:
    return _script(name[0])


def _ascii(value: str) -> str:
    """Digits of any script as 0 to 9."""
    return value if value.isascii() else "".join(str(unicodedata.digit(c)) if c.isdigit() else c for c in value)


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[::-2])) + sum(int(d.translate(_LUHN)) for d in digits[-2::-2])) % 10 == 0


def canonical(kind: str, value: str) -> str:
    """What two spellings of one entity have in common."""
    value = _ascii(value)
    if kind in ("card", "national"):
        return re.sub(r"\D", "", value)
    if kind == "phone":
        digits = re.sub(r"\D", "", value)
        return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    if kind == "iban":
        return value.replace(" ", "")
    if kind.startswith(("given", "surname")) and kind.endswith("cyrillic") and value.lower() not in _GENDER:
        return re.sub(r"(ов|ев|ин|ын)а$", r"\1", value.lower())
    return value if kind == "secret" else value.lower()


def entity_kind(kind: str) -> str:
    """Words of names are one kind for each script, whatever part they are."""
    return f"name_{kind.rsplit('_', 1)[1]}" if kind.startswith(("given", "surname")) else kind


def _capital(word: str) -> bool:
    return word[:1].isupper()


def _people(text: str) -> Iterator[tuple[str, int, int]]:
    """Name words after a title, and known given names before a surname."""
    at = 0

    def taken(start: int, gender: str, titled: bool) -> tuple[list[tuple[str, int, int]], int]:
        """All words of the name: capitalised, with particles between them, and
        initials with their stop."""
        found, behind, end, at = [], [], start, start
        while (m := _STEP.match(text, at)) and _capital(m[2]):
            joined = JOINING.intersection(m[1].split()) and m[2].lower() in _GENDER
            if joined or (found or m[1]) and m[2].lower() in _TITLE:
                break
            found.append((m[2], *m.span(2)))
            behind.append(bool(m[1]))
            at = end = m.end()
            if text.startswith(" ", end):
                at = end + 1
            elif len(m[2]) == 1 and text.startswith(".", end):
                at = end + 1 + text.startswith(" ", end + 1)
            else:
                break
        if not found or not titled and len(found) < 2:
            return [], start
        known, n = _GENDER.get(found[0][0].lower()), len(found)
        # surnames: what follows a particle, or the last word, of four and more the last two
        last = n - 2 if n > 3 else n - 1
        for i in range(n):
            if behind[i] and (i == n - 1 or found[i][0].lower() not in _GENDER):
                last = i
                break
        out = []
        for i, (w, s, e) in enumerate(found):
            if i < last or known and n == 1 and not behind[0]:
                g = gender or (known or _GENDER.get(w.lower()) or ("", "n"))[1]
                out.append((f"given_{g}_{script_of(w)}", s, e))
            else:
                out.append((f"surname_{script_of(w)}", s, e))
        return out, end

    for m in _TITLED.finditer(text):
        if m.start() >= at and _capital(m[1]):
            got, end = taken(m.end(), _TITLE[m[1].lower()], True)
            yield from got
            at = max(at, end)
    for m in _GIVEN.finditer(text):
        got, _ = taken(m.start(), "", False)
        yield from got


_AFTER = {t: g for g, ts in BEHIND.items() for t in ts}
_AHEAD = {t: g for g, ts in BEFORE.items() for t in ts}
_BEHIND = re.compile(rf"([\u4e00-\u9fff\u30a0-\u30ff]{{2,}}|(?<![\uac00-\ud7af])[\uac00-\ud7af]{{2,4}}?) ?({'|'.join(sorted(_AFTER, key=len, reverse=True))})")
_LETTERS = r"[\u0590-\u05ff\u0600-\u065f\u066e-\u06ef\u0900-\u0963\u10a0-\u10ff]+"
_BEFORE = re.compile(rf"(?<!\w)({'|'.join(map(re.escape, sorted(_AHEAD, key=len, reverse=True)))}) ?(?<=[ .])({_LETTERS})(?: ({_LETTERS}))?")


def _caseless(text: str) -> Iterator[tuple[str, int, int]]:
    """Names beside a title, in scripts without case: two words at most."""
    for m in _BEHIND.finditer(text):
        s, e = m.span(1)
        if _script(m[1][-1]) == "han":
            # a surname and one or two further characters
            s = next((e - k for k in (3, 2) if e - k >= s and text[e - k] in HAN_SURNAMES), max(s, e - 2))
        script, g = script_of(text[s]), _AFTER[m[2]] or "n"
        yield f"surname_{script}", s, s + 1
        if s + 1 < e:
            yield f"given_{g}_{script}", s + 1, e
    for m in _BEFORE.finditer(text):
        script, g = script_of(m[2]), _AHEAD[m[1]] or "n"
        if m[3]:
            yield f"given_{g}_{script}", *m.span(2)
            yield f"surname_{script}", *m.span(3)
        else:
            yield f"surname_{script}", *m.span(2)


_GIVEN = re.compile(rf"(?<!\w)(?:{'|'.join(n.capitalize() for n in _GENDER)})(?= [^\W\d_])")


def detect(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the entities, in order, without overlaps."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    has_digit = re.search(r"\d", text) is not None
    if "@" in text:
        found += [("email", *m.span()) for m in _RE["email"].finditer(text)]
    if "=" in text or ":" in text:
        found += [("secret", *m.span(1)) for m in _RE["secret"].finditer(text)]
    if has_digit:
        for kind in ("iban", "ip6", "ip", "card", "national", "phone"):
            found += [(kind, *m.span()) for m in _RE[kind].finditer(text)]
    people = list(_people(text)) + ([] if text.isascii() else list(_caseless(text)))
    found += people
    # the same names elsewhere in the text, without title or given name
    known = {text[s:e]: k for k, s, e in people if e - s > 1}
    if known:
        for m in _WORD.finditer(text):
            if m[0] in known:
                found.append((known[m[0]], *m.span()))
            elif "'" in m[0] or "’" in m[0] or "-" in m[0]:
                found += [(known[p[0]], *p.span()) for p in _PART.finditer(text, *m.span()) if p[0] in known]
    out, end = [], 0
    rank = {k: i for i, k in enumerate(_RE)}
    for kind, s, e in sorted(found, key=lambda x: (x[1], rank.get(x[0], 9), -x[2])):
        if s >= end:
            out.append((kind, s, e))
            end = e
    return out


class _Draw:
    """Pseudo-random choices keyed by a secret, an entity and an attempt."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{canon}\0{attempt}".encode(), hashlib.sha256).digest()
        self.n, self.pool = 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hashlib.sha256(self.seed + self.n.to_bytes(8, "big")).digest()
            self.n += 1
        v, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return v % n

    def of(self, values: list[str] | str) -> str:
        return values[self.below(len(values))]

    def like(self, text: str, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
        """Digits for digits, letters for letters of the script, anything else
        unchanged."""
        return "".join(self._one(c, letters) for c in text)

    def _one(self, c: str, letters: str) -> str:
        if c.isdigit():
            return str(self.below(10))
        if c.isascii():
            return self.of(letters) if c.islower() else self.of(letters).upper() if c.isupper() else c
        return self.of(_mates(ord(c) >> 7, unicodedata.category(c), _script(c))) if c.isalpha() else c


@cache
def _mates(block: int, category: str, script: str) -> str:
    """Letters near one another, of the same script and category."""
    near = map(chr, range(block << 7, (block + 1) << 7))
    return "".join(c for c in near if unicodedata.category(c) == category and _script(c) == script)


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical form of a replacement for a canonical form."""
    d = _Draw(key, kind, canon, attempt)
    more = "" if attempt < 8 else "x" * (attempt // 8)
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels = domain.split(".")
        top = labels[-1] if labels[-1] in ("com", "net", "org") else None
        tail = ["example", top] if top else ["example"]
        head = [d.like(x) for x in labels[: max(0, len(labels) - 2)]]
        return d.like(local + more) + "@" + ".".join(head + tail)
    if kind == "ip":
        a, b, c, _ = canon.split(".")
        if a == "10" or a == "127":
            fixed = [a]
        elif (a, b) == ("192", "168") or a == "172" and 16 <= int(b) < 32:
            fixed = [a, b]
        else:
            first = d.of([str(x) for x in range(11, 224) if x not in (127, 169, 172, 192)])
            fixed = [first]
        return ".".join(fixed + [str(1 + d.below(254)) for _ in range(4 - len(fixed))])
    if kind == "ip6":
        head = canon[:4] if re.match("fe[89ab]|f[cd]", canon) else ""
        return head + d.like(canon[len(head) :], "abcdef")
    if kind == "card":
        body = canon[:2] + d.like(canon[2:-1])
        good = next(c for c in "0123456789" if luhn(body + c))
        return body + (good if luhn(canon) else str((int(good) + 1 + d.below(9)) % 10))
    if kind == "phone":
        out = list(d.like(canon))
        if len(canon) == 10:
            out[0], out[3] = str(2 + d.below(8)), str(2 + d.below(8))
        else:
            code = 1 if canon[0] in "17" else 2 if canon[:2] in TWO_DIGITS else 3
            out[:code] = canon[:code]
        return "".join(out)
    if kind == "iban":
        body = d.like(canon[4:])
        number = "".join(str(int(c, 36)) for c in body + canon[:2] + "00")
        return f"{canon[:2]}{98 - int(number) % 97:02d}{body}"
    if kind.startswith("given"):
        _, g, script = kind.split("_")
        if script not in SYLLABLES:
            return d.like(canon + canon[-1] * (attempt // 4))
        if attempt < 4 and (script, g) in GIVEN:
            return d.of(GIVEN[script, g])
        return "".join(d.of(SYLLABLES[script]) for _ in range(1 + attempt // 4)) + d.of(ENDINGS[script, g])
    if kind.startswith("surname"):
        script = kind.split("_")[1]
        if script not in SYLLABLES:
            return d.like(canon + canon[-1] * (attempt // 4))
        base = "".join(d.of(SYLLABLES[script]) for _ in range(3 + attempt // 4))
        if script == "cyrillic":
            return base + (m[0] if (m := re.search(r"(?:ов|ев|ин|ын)$", canon)) else "н")
        return base + d.of(ENDINGS[script, "m"])
    return d.like(canon, "abcdef") if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canon) else d.like(canon)


def number_class(kind: str, canon: str) -> str:
    """What the surrogate of a number has in common with it, besides its kind."""
    if kind == "ip":
        first, second = canon.split(".")[:2]
        return first if first in ("10", "127") else f"{first}.{second}" if (first, second) == ("192", "168") or first == "172" else ""
    if kind in ("card", "iban"):
        return f"{canon[:2]} {len(canon)} {kind == 'card' and luhn(canon)}"
    return f"{canon[:3]} {len(canon)}" if kind == "phone" and len(canon) != 10 else str(len(canon))


def laid_out(kind: str, value: str, canon: str, new: str) -> str:
    """``new`` in the spelling of ``value``: separators, country code, case, and
    digits of its script."""
    if kind in ("card", "national", "phone", "iban"):
        skip = len([c for c in value if c.isalnum()]) - len(canon)
        it, out = iter(new), []
        for c in value:
            if not c.isalnum():
                out.append(c)
            elif skip > 0:
                out.append(c)
                skip -= 1
            else:
                out.append(chr(ord(c) - unicodedata.digit(c) + int(next(it))) if c.isdigit() and not c.isascii() else next(it))
        return "".join(out)
    if kind.startswith(("given", "surname")):
        if kind.endswith("cyrillic") and value.lower() != canon and not new.endswith("а"):
            new += "а"
        return new.upper() if len(value) > 1 and value.isupper() else new[:1].upper() + new[1:]
    return new


_S = T.StringType()
_FOUND = T.ArrayType(T.StructType([T.StructField(c, _S) for c in ("kind", "canon", "part")]))
_DONE = T.StructType([T.StructField("text", _S), T.StructField("n", T.LongType())])


@F.arrow_udf(_FOUND)
def _entities(text: pa.Array) -> pa.Array:
    rows = []
    for t in text.to_pylist():
        got = {(entity_kind(k), canonical(k, t[s:e]), k) for k, s, e in detect(t)}
        rows.append([{"kind": k, "canon": c, "part": p} for k, c, p in sorted(got)])
    return pa.array(rows, pa.list_(pa.struct([(c, pa.string()) for c in ("kind", "canon", "part")])))


@F.arrow_udf(_DONE)
def _replaced(text: pa.Array, table: pa.Array) -> pa.Array:
    out, count = [], []
    for t, entries in zip(text.to_pylist(), table.to_pylist(), strict=True):
        known = {(x["kind"], x["canon"]): x["new"] for x in entries or []}
        parts, at, n = [], 0, 0
        for k, s, e in detect(t) if known else []:
            canon = canonical(k, t[s:e])
            if (new := known.get((entity_kind(k), canon))) is not None:
                parts += [t[at:s], laid_out(k, t[s:e], canon, new)]
                at, n = e, n + 1
        out.append(t if t is None else "".join(parts) + t[at:])
        count.append(n)
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(count, pa.int64())], ["text", "n"])


def assign(entities: DataFrame, key: bytes, rounds: int = 16) -> DataFrame:
    """kind, canon, part -> kind, canon, new, without collisions.

    ``part`` is the part of a name that a word is; one that is met as a surname
    is one, and a given name met with both genders has none.

    A candidate is refused if it is the entity itself, or any entity of the
    table (other than a name: those come from lists), or was given before; of several that meet, the one of the smallest
    entity stays.  The refused draw again in the next round.  What is left
    after ``rounds`` of them is permuted, see ``_permuted``.
    """

    def drawer(attempt: int):
        @F.arrow_udf(_S)
        def draw(kind: pa.Array, canon: pa.Array) -> pa.Array:
            pairs = zip(kind.to_pylist(), canon.to_pylist(), strict=True)
            return pa.array([surrogate(key, k, c, attempt) for k, c in pairs], pa.string())

        return draw

    # min of the parts, but a given name of several genders is neutral
    genders = F.count_distinct(F.when(F.col("part").like("given%"), F.col("part")))
    neutral = F.regexp_replace(F.min("part"), "^given_[a-z]", "given_n")
    part = F.when(F.max("part").like("surname%"), F.max("part")).when(genders > 1, neutral).otherwise(F.max("part"))
    every = cut(entities.groupBy("kind", "canon").agg(part.alias("part")))
    real = every.where("kind not like 'name%'").select("kind", F.col("canon").alias("new"))
    todo, given = every, None
    for attempt in range(rounds):
        if todo.isEmpty():
            break
        drawn = cut(todo.withColumn("new", drawer(attempt)("part", "canon")))
        free = drawn.where(F.col("new") != F.col("canon")).join(real, ["kind", "new"], "left_anti")
        if given is not None:
            free = free.join(given.select("kind", "new"), ["kind", "new"], "left_anti")
        won = cut(free.groupBy("kind", "new").agg(F.min("canon").alias("canon")).select("kind", "canon", "new"))
        todo = cut(todo.join(won, ["kind", "canon"], "left_anti"))
        given = won if given is None else given.unionByName(won)
    if given is None:
        return every.select("kind", "canon", F.lit(None).cast("string").alias("new"))
    return given if todo.isEmpty() else _permuted(todo, given, key)


def _permuted(left: DataFrame, given: DataFrame, key: bytes) -> DataFrame:
    """Surrogates for what found no free one: each entity left gets the value
    of the next one of its class, in a keyed order.  Nobody else has these
    values, as real ones are refused.  One entity of the class that has a
    surrogate joins in with it, so that none keeps its own value.

    A class is sorted by one task; it is at most as large as its numbers are
    few, or this would not be reached.
    """

    @F.arrow_udf(_S)
    def klass(kind: pa.Array, canon: pa.Array) -> pa.Array:
        return pa.array([number_class(k, c) for k, c in zip(kind.to_pylist(), canon.to_pylist(), strict=True)], pa.string())

    @F.arrow_udf(_S)
    def keyed(value: pa.Array) -> pa.Array:
        return pa.array([hmac.new(key, v.encode(), hashlib.sha256).hexdigest() for v in value.to_pylist()], pa.string())

    left = left.select("kind", "canon", klass("kind", "canon").alias("class"), F.col("canon").alias("v"))
    known = given.withColumn("class", klass("kind", "canon"))
    some = known.join(left.select("kind", "class").distinct(), ["kind", "class"])
    one = cut(some.groupBy("kind", "class").agg(F.min_by(F.struct("canon", "new"), "canon").alias("x")))
    one = one.select("kind", "x.canon", "class", F.col("x.new").alias("v"))
    order = Window.partitionBy("kind", "class").orderBy("rank")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = left.unionByName(one).withColumn("rank", keyed("v"))
    moved = moved.select("kind", "canon", F.coalesce(F.lead("v").over(order), F.first("v").over(whole)).alias("new"))
    return cut(given.join(one.select("kind", "canon"), ["kind", "canon"], "left_anti").unionByName(moved))


def replace_entities(
    docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row: doc_id, text (with surrogates), n_entities.

    ``key``: the secret that surrogates depend on; there is no default.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(id_col, text_col).withColumn("_t", F.xxhash64(text_col))
    found = cut(rows.select("_t", F.explode(_entities(F.col(text_col))).alias("x")).select("_t", "x.*").distinct())
    given = assign(found, key)
    table = (
        found.select("_t", "kind", "canon").distinct()
        .join(given, ["kind", "canon"])
        .groupBy("_t")
        .agg(F.collect_list(F.struct("kind", "canon", "new")).alias("_e"))
        .withColumnRenamed("_t", "_k")
    )
    known = Bloom(found, "_t")
    seen = known.might_contain("_t")
    clear = rows.where(~seen).select(id_col, text_col, F.lit(0).cast("long").alias("n_entities"))
    moved = rows.where(seen).join(table, F.col("_t") == F.col("_k"), "left")
    moved = moved.withColumn("_r", _replaced(F.col(text_col), F.col("_e")))
    return clear.unionByName(
        moved.select(id_col, F.col("_r.text").alias(text_col), F.col("_r.n").alias("n_entities"))
    )
