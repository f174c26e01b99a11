"""Personal data by a semi-Markov conditional random field over whole spans, beside exact patterns.

Patterns give the base spans. The field reads the zones of a text that hold digits or an at sign: it scores candidate
segments by features of the whole span (digits and their grouping, checksum, separators, address parts, the words ahead)
and picks boundaries and types together by dynamic programming, entities being at most MAX_TOKENS tokens long. Its
weights are learnt by maximum likelihood on zones that are made here from shapes of personal and of other data. Spans
that it finds where no base span is are added.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]
MAX_TOKENS, REACH = 40, 48

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:\x20?[0-9]|-?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Each at sign takes the run of address characters before it, up to the last match, and a dotted name after it; so one pass does."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield "email", start, done
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """The patterns' matches, leftmost and non-overlapping for each kind; those that fail their check are dropped."""
    out = list(_emails(text)) if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ---- the field

# Words that often stand ahead of each kind.
AHEAD = {
    "email": "mail email correo courriel contact contacto kontakt write",
    "ip": "ip ipv4 ipv6 host server addr address adresse gateway dns",
    "card": "card visa mastercard amex credit debit carte karte tarjeta payment",
    "phone": "tel phone telephone call mobile fax fon telefon telefono móvil handy whatsapp",
    "other": "version order invoice isbn page id no nr ref date year price total token key hash sha serial build",
}
_AHEAD = {w: kind for kind, words in AHEAD.items() for w in words.split()}
_HOT = re.compile(r"[0-9]+|@|[(\[](?:at|AT)[)\]]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s|.", re.S)
_AT = re.compile(r"@|[(\[](?:at|AT)[)\]]")
_MAIL = re.compile(r"[\w.%+-]*\w ?(?:@|[(\[](?:at|AT)[)\]]) ?[\w-]+(?:(?:\.| ?[(\[](?:dot|DOT)[)\]] ?)[\w-]+)+")
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?")
_SIX = re.compile(r"(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}")
#: An address of six: eight groups, or fewer and one empty run between them; a name with colons and two short groups is none.
_SIX_WHOLE = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}")
_SIX_SHORT = re.compile(r"(?=.{3})(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?")
_SIX_HEAD = re.compile(r"^::|^(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{3,4}:")
_SIX_TAIL = re.compile(r"(?:(?<![^\W_])[0-9A-Fa-f]{1,4}|[:.]):\Z")
_DOT = re.compile(r" ?[(\[](?:dot|DOT)[)\]]")
_DOTS = re.compile(r"(?: ?[(\[](?:dot|DOT)[)\]] ?[\w-]+)+")
#: What numbers are made of, and how many separators may stand together.
_NUMBER, _CARD_SEPS, SEPS = frozenset("0123456789 +().-/"), frozenset(" .-"), 3
#: Groups of digits that a number may have; one without a plus sign, brackets or zeros ahead has fewer.
GROUPS, BARE_GROUPS = 6, 5
_PART = frozenset("_.%+-")
_DATE = re.compile(r"(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2})(?:[T ][0-9:.]+)?")
_GROUPS = re.compile(r"[0-9]+")


def zones(text: str) -> Iterator[tuple[int, int]]:
    """The stretches that the field reads: what hangs together around digits and at signs, over one or two spaces."""
    start = end = -1
    for m in _HOT.finditer(text):
        a, b = m.span()
        low = max(a - REACH, end, 0)
        while a > low and not text[a - 1].isspace():
            a -= 1
        high = min(b + REACH, len(text))
        while b < high and not text[b].isspace():
            b += 1
        if _AT.fullmatch(text, a, b):  # set apart by spaces: the words beside it belong to it
            if a > low and text[a - 1] == " ":
                a -= 1
                while a > low and not text[a - 1].isspace():
                    a -= 1
            if b < high and text[b] == " ":
                b += 1
                while b < high and not text[b].isspace():
                    b += 1
        if text[b - 1 : b] in ("]", ")") or text[b : b + 2] in (" [", " ("):  # a name's dots, spelt out
            m = _DOTS.match(text, b)
            b = m.end() if m else b
        if start >= 0 and (a <= end or text[end:a] in (" ", "  ")):
            end = max(end, b)
        else:
            if start >= 0:
                yield start, end
            start, end = a, b
    if start >= 0:
        yield start, end


def six(s: str) -> bool:
    """Whether s is an address of six."""
    if s.count(":") < 2:
        return False
    return bool(_SIX_WHOLE.fullmatch(s) or _SIX_SHORT.fullmatch(s) and (sum(map(bool, s.split(":"))) >= 3 or _SIX_HEAD.search(s)) and any("0" <= c <= "9" for c in s))


def features(s: str, before: str, after: str) -> list[str]:
    """Features of the whole span s and of what surrounds it."""
    d = _digits(s)
    n = len(d)
    f = [f"digits={n if 6 < n < 20 else 'few' if n <= 6 else 'many'}"]
    letters = sum(c.isalpha() for c in s)
    if letters:
        f.append("letters" if letters <= n else "mostly letters")
    if n and not letters:
        f.append(f"luhn={luhn(d)}")
        groups = _GROUPS.findall(s)
        f.append("groups=" + "-".join(str(len(g)) for g in groups) if len(groups) <= 6 else "groups=many")
        seps = "".join(sorted({c for c in s if not c.isdigit()}))
        f.append(f"seps={seps}")
    if s[0] == "+":
        f.append("plus")
    if s.startswith("00"):
        f.append("00")
    if s[0] == "(":
        f.append("bracket")
    if s.count("(") != s.count(")") or s.count("[") != s.count("]"):
        f.append("unbalanced")
    if _MAIL.fullmatch(s):
        f += ["mail", "mail=" + ("@" if "@" in s else "at")]
        if s.rsplit(".", 1)[-1][-2:].isalpha():
            f.append("tld")
        if _DOT.match(after):
            f.append("goes on")
    elif _AT.search(s):
        f.append("no mail")
    if _QUAD.fullmatch(s):
        f.append("quad=" + str(all(int(p) <= 255 for p in s.split(":")[0].split("."))))
    elif six(s):
        f.append("six=" + str(any(c in "abcdefABCDEF" for c in s) or "::" in s or s.count(":") == 7))
    elif s.count(":") or s.count(".") > 2:
        f.append("other dotted")
    if _DATE.fullmatch(s):
        f.append("date")
    if before[-1:] and not before[-1].isspace():
        f.append("before=" + (before[-1] if before[-1] in "=\"':#$€£@/([" else "x"))
    if after[:1] and not after[0].isspace():
        f.append("after=" + (after[0] if after[0] in "%\"')]/@.,;:!?" else "x"))
    words = re.findall(r"[^\W\d_]+", before[-24:].lower())
    f.append("ahead=" + next((_AHEAD[w] for w in reversed(words[-2:]) if w in _AHEAD), "none"))
    return f


Candidate = tuple[int, int, int, int, list[int], list[str]]


def candidates(text: str, start: int, end: int) -> tuple[int, list[Candidate]]:
    """The number of tokens of a zone and its candidates: (from token, to token, start, end, kinds, features)."""
    bounds = _bounds(text, start, end)
    return len(bounds) - 1, list(_candidates(text, bounds))


def _bounds(text: str, start: int, end: int) -> list[int]:
    return [start, *(m.end() for m in _TOKEN.finditer(text, start, end))]


def _candidates(text: str, bounds: list[int]) -> Iterator[Candidate]:
    """By start, so that a zone without end can be read as it goes.

    Each kind is followed from a start only as long as a segment can still become one, so few get features: numbers over
    digits and separators up to so many groups, addresses by their form, mail over one at sign, from where its name begins.
    """
    n = len(bounds) - 1
    ats = [m.start() for m in _AT.finditer(text, bounds[0], bounds[-1])]
    at = 0
    for i in range(n):
        a = bounds[i]
        while at < len(ats) and ats[at] < a:
            at += 1
        first, ahead = text[a], text[a - 1] if a else " "
        if not (first.isalnum() or first in "+(:") or ahead.isalnum() and first.isalnum():
            continue
        ends: dict[int, list[int]] = {}
        if at < len(ats) and ats[at] - a <= 64 and first.isalnum() and not (ahead.isalnum() or ahead in _PART):
            for j in _mail_ends(text, bounds, i, n, ats[at], ats[at + 1] if at + 1 < len(ats) else len(text)):
                ends.setdefault(j, []).append(0)
        if ("0" <= first <= "9" or first == ":" or "a" <= first <= "f" or "A" <= first <= "F") and not _within_address(text, a):
            for j in _address_ends(text, bounds, a):
                ends.setdefault(j, []).append(1)
        if "0" <= first <= "9" or first in "+(":
            for j, kinds in _number_ends(text, bounds, i, n):
                ends.setdefault(j, []).extend(kinds)
        for j in sorted(ends):
            b = bounds[j]
            if not (b < len(text) and text[b].isalnum() and text[b - 1].isalnum()):
                yield i, j, a, b, ends[j], features(text[a:b], text[max(0, a - 32) : a], text[b : b + 6])


def _mail_ends(text: str, bounds: list[int], i: int, n: int, at: int, following: int) -> Iterator[int]:
    """Where a mail address over the one at sign can end: after the parts of its name."""
    if any(c not in _PART and not c.isalnum() for c in text[bounds[i] : at].removesuffix(" ")):
        return
    for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
        b = bounds[j]
        if b > following or b - bounds[i] > 120:
            return
        if b > at + 1 and text[b - 1].isalnum():
            yield j


def _within_address(text: str, a: int) -> bool:
    """Whether what stands ahead of a may be the beginning of a longer address or version."""
    if not a or text[a - 1] not in ".:":
        return False
    return text[a - 1] == "." or bool(_SIX_TAIL.search(text, max(0, a - 6), a))


def _address_ends(text: str, bounds: list[int], a: int) -> Iterator[int]:
    for form, fits in ((_QUAD, None), (_SIX, six)):
        m = form.match(text, a)
        if m and text[m.end() : m.end() + 1] != ":" and not (text[m.end() : m.end() + 1] == "." and text[m.end() + 1 : m.end() + 2].isdigit()) and (fits is None or fits(m[0])):
            j = bisect_left(bounds, m.end())
            if j < len(bounds) and bounds[j] == m.end():
                yield j


def _number_ends(text: str, bounds: list[int], i: int, n: int) -> Iterator[tuple[int, list[int]]]:
    """Where a card's or a phone's number can end."""
    digits = groups = seps = 0
    card = phone = True
    most = GROUPS if text[bounds[i]] in "+(" or text.startswith("00", bounds[i]) else BARE_GROUPS
    for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
        a, b = bounds[j - 1], bounds[j]
        c = text[a]
        if c not in _NUMBER:
            return
        if "0" <= c <= "9":
            digits, groups, seps = digits + b - a, groups + 1, 0
            if digits > 19 or groups > GROUPS:
                return
            if card and 12 <= digits or phone and groups <= most and 7 <= digits <= 15:
                yield j, [2] * (card and 12 <= digits) + [3] * (phone and groups <= most and 7 <= digits <= 15)
        else:
            seps += 1
            card = card and c in _CARD_SEPS
            phone = phone and (c != "+" or j == i + 1 or text[a - 1] == "(")
            if seps > SEPS:
                return


Weights = dict[tuple[str, int], float]


def _scored(cands, w: Weights) -> Iterator[tuple[int, int, int, int, float, list[str]]]:
    get = w.get
    return ((i, j, c, k, get(("", k), 0.0) + sum(get((x, k), 0.0) for x in f), f) for c, (i, j, _, _, kinds, f) in enumerate(cands) for k in kinds)


def _scores(cands, w: Weights) -> list[tuple[int, int, int, int, float, list[str]]]:
    return list(_scored(cands, w))


def decode(n: int, cands, w: Weights) -> list[tuple[int, int]]:
    """The best segmentation: (candidate, kind) of its entities. Tokens outside score nothing; a touching pair scores w['touch']."""
    return [(c, k) for _, _, c, k in _decode(n, cands, w)]


def _decode(n: int, cands, w: Weights) -> list[tuple[int, int, int, int]]:
    """(from token, to token, candidate, kind) of the best segmentation. Candidates come by start and aren't kept."""
    touch = w.get(("touch", -1), 0.0)
    by_end: dict[int, list] = {}
    coming = _scored(cands, w)
    x = next(coming, None)
    out_of, within = [0.0] * (n + 1), [-math.inf] * (n + 1)
    back_o, back_e = [0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        while x is not None and x[0] < j:
            by_end.setdefault(x[1], []).append(x[:5])
            x = next(coming, None)
        out_of[j], back_o[j] = max((out_of[j - 1], 0), (within[j - 1], 1))
        for i, _, c, k, s in by_end.pop(j, ()):
            v, state = max((out_of[i], 0), (within[i] + touch, 1))
            if v + s > within[j]:
                within[j], back_e[j] = v + s, (i, c, k, state)
    found, j, state = [], n, int(within[n] > out_of[n])
    while j > 0:
        if state:
            i, c, k, state = back_e[j]
            found.append((i, j, c, k))
            j = i
        else:
            j, state = j - 1, back_o[j]
    return found[::-1]


def _lse(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


def _expect(n: int, cands, w: Weights) -> tuple[float, list[tuple[float, int, list[str]]], float]:
    """log Z, each candidate's chance with kind and features, and the expected number of touching pairs: forward and backward."""
    touch = w.get(("touch", -1), 0.0)
    scored = _scores(cands, w)
    by_end: dict[int, list] = {}
    by_start: dict[int, list] = {}
    for x in scored:
        by_end.setdefault(x[1], []).append(x)
        by_start.setdefault(x[0], []).append(x)
    fo, fe = [0.0] * (n + 1), [-math.inf] * (n + 1)
    for j in range(1, n + 1):
        fo[j] = _lse(fo[j - 1], fe[j - 1])
        for i, _, _, _, s, _ in by_end.get(j, ()):
            fe[j] = _lse(fe[j], s + _lse(fo[i], fe[i] + touch))
    bo, be = [0.0] * (n + 1), [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        bo[i] = be[i] = bo[i + 1]
        for _, j, _, _, s, _ in by_start.get(i, ()):
            bo[i], be[i] = _lse(bo[i], s + be[j]), _lse(be[i], touch + s + be[j])
    z = bo[0]
    chances, touching = [], 0.0
    for i, j, _, k, s, f in scored:
        chances.append((math.exp(s + _lse(fo[i], fe[i] + touch) + be[j] - z), k, f))
        touching += math.exp(fe[i] + touch + s + be[j] - z) if fe[i] > -math.inf else 0.0
    return z, chances, touching


def training_zones(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Made-up texts with one value each: personal data in many shapes, with its span, or something else with none."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(2, 8)))
    host = lambda: ".".join([word() + r.choice(["", num(1)]) for _ in range(r.randint(1, 2))] + [r.choice(["com", "org", "net", "de", "es", "fr", "io"])])
    byte = lambda: str(r.randint(0, 255))

    def card() -> str:
        d = r.choice("3456") + num(r.choice([13, 14, 14, 14, 14, 17]))
        return next(d + c for c in "0123456789" if luhn(d + c))

    def grouped(d: str, sep: str) -> str:
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def email() -> str:
        local = r.choice([word(), f"{word()}.{word()}", word() + num(2), f"{word()}_{word()}", word() + "é"])
        return r.choice([f"{local}@{host()}"] * 5 + [f"{local}(at){host()}", f"{local} [at] {host()}", f"{local} @ {host()}", f"{local}[at]{word()}[dot]com", f"{local} [at] {word()} [dot] {r.choice(['com', 'org', 'co [dot] uk'])}", f"{local} (at) {word()} (dot) {r.choice(['net', 'com (dot) au'])}"])

    def address() -> str:
        parts = [f"{r.randint(0, 65535):x}" for _ in range(8)]
        return ":".join(parts) if r.random() < 0.5 else ":".join(parts[: r.randint(1, 4)]) + "::" + ":".join(parts[5 : 5 + r.randint(1, 3)])

    yes = {
        "email": [email],
        "ip": [lambda: ".".join(byte() for _ in range(4)), lambda: ".".join(byte() for _ in range(4)), address],
        "card": [card, card, lambda: grouped(card(), " "), lambda: grouped(card(), "-"), lambda: grouped(card(), "."), lambda: grouped(card(), "  ")],
        "phone": [
            lambda: f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", lambda: f"+{r.randint(20, 99)} {num(3)} {num(3)} {num(3)}", lambda: f"+{r.randint(1, 99)}{num(10)}",
            lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"00{r.randint(20, 99)} {num(2)} {num(7)}", lambda: f"+{r.randint(20, 99)} (0){num(2)}/{num(6)}", lambda: f"{num(3)}.{num(3)}.{num(4)}",
        ],
    }

    def bad_card() -> str:
        d = card()
        return d[:-1] + str((int(d[-1]) + r.randint(1, 9)) % 10)

    two = lambda: f"{r.randint(0, 59):02}"
    day = lambda: r.choice(["{0}-{1}-{2}", "{0}/{1}/{2}", "{2}.{1}.{0}", "{2}/{1}/{0}", "{0}{1}{2}", "{0} {1} {2}"]).format(r.randint(1970, 2039), f"{r.randint(1, 12):02}", f"{r.randint(1, 28):02}")
    time = lambda: f"{r.randint(0, 23):02}:{two()}:{two()}" + r.choice(["", "", f",{num(3)}", f".{num(3)}", f".{num(6)}"])
    hex_ = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    no = [
        # What stands in logs, tables and references.
        lambda: f"{day()} {time()}", lambda: f"{day()} {time()} [{num(5)}] {num(3)} {num(4)}", lambda: f"{day()}T{time()}Z {num(4)}", lambda: f"{day()} {day()}", lambda: f"{day()} - {day()}", lambda: " ".join(time() for _ in range(r.randint(2, 4))),
        lambda: ", ".join(f"{num(1)}:{num(1)}-{num(1)}" for _ in range(r.randint(2, 5))), lambda: " ".join(":".join(num(1) for _ in range(3)) for _ in range(r.randint(2, 4))), lambda: r.choice(":-").join(hex_(2) for _ in range(6)),
        lambda: f"{word()}::{word()}::{num(1)}", lambda: f"{hex_(1)}::{hex_(1)}::{num(1)}", lambda: f"{word()}={hex_(3)}:{num(3)}:{num(3)}:{num(3)}", lambda: f"{num(2)}.{num(4)}, {num(2)}.{num(4)}", lambda: f"{num(2)}.{num(5)} {num(2)}.{num(5)}",
        lambda: f"{num(2)} + {num(3)} - {num(4)}", lambda: f"{num(3)}.{num(3)}.{num(3)},{num(2)}", lambda: " ".join(num(r.randint(1, 3)) for _ in range(r.randint(4, 8))), lambda: "  ".join(num(4) for _ in range(r.randint(2, 3))),
        lambda: f"{num(3)}-{num(3)}", lambda: f"{num(4)}-{num(4)} {num(4)}", lambda: f"{r.randint(1900, 2039)} {r.randint(1900, 2039)} {r.randint(1900, 2039)}", lambda: f"{num(8)}-{hex_(4)}-4{hex_(3)}-{hex_(4)}-{num(12)}", lambda: f"{num(2)}-{num(2)}-{num(4)} {num(2)}",
        lambda: " ".join(f"{num(2)}/{num(2)}" for _ in range(r.randint(2, 5))) + r.choice(["", " " + num(2)]), lambda: " ".join(num(1) for _ in range(r.randint(7, 13))), lambda: f"{num(3)}x{num(3)}x{num(4)}",
        lambda: ", ".join(num(r.randint(2, 4)) for _ in range(r.randint(3, 6))), lambda: f"{num(4)}/{num(4)}/{num(4)}/{num(4)}",
        bad_card, lambda: grouped(bad_card(), " "), lambda: num(r.randint(1, 13)), lambda: num(r.randint(18, 40)), lambda: f"{r.randint(1900, 2099)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2099)}", lambda: f"{r.randint(1, 28)}.{r.randint(10, 12)}.{r.randint(1900, 2099)}", lambda: f"{num(2)}:{num(2)}:{num(2)}",
        lambda: f"{r.randint(0, 9)}.{num(r.randint(2, 12))}", lambda: ".".join(num(1) for _ in range(3)), lambda: ".".join(str(r.randint(256, 999)) for _ in range(4)), lambda: f"${num(3)},{num(3)}.{num(2)}",
        lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))), lambda: f"{r.randint(1900, 2000)}-{r.randint(2001, 2050)}",
        lambda: "@" + word() + num(2), lambda: f"{word()}@{word()}", lambda: f"{num(4)} {num(4)}", lambda: f"#{num(8)}", lambda: f"{num(2)}-{num(5)}", lambda: f"{num(2)}.{num(2)}.{num(2)}.{num(2)}.{num(2)}", lambda: f"{num(3)} {num(3)} {num(3)}",
    ]
    ahead = {k: v.split() for k, v in AHEAD.items()}
    out = []
    for _ in range(n):
        kind = r.choice([*KINDS, "", ""])
        value = r.choice(yes[kind])() if kind else r.choice(no)()
        lead = r.choice([r.choice(ahead[kind or "other"])] + [word()] * 3) + r.choice([" "] * 6 + [": ", ":", ' = "'])
        tail = r.choice([" "] * 5 + [". ", ", ", "%%% ", '" ', "!! ", ") "]) + word()
        bare = not kind and r.random() < 0.4  # lines that begin with what is no personal data
        text = ("" if bare else word().capitalize() + " " + lead) + value + tail
        at = len(text) - len(tail) - len(value)
        out.append((text, [(kind, at, at + len(value))] if kind else []))
    return out


@lru_cache(maxsize=2)
def trained(n: int = 1500, epochs: int = 12, seed: int = 7) -> tuple[tuple[tuple[str, int], float], ...]:
    """Weights that make the training zones' segmentations likeliest, by stochastic gradient steps sized for each weight."""
    made = []
    for text, gold in training_zones(n, seed):
        for a, b in zones(text):
            count, cands = candidates(text, a, b)
            if cands:
                made.append((count, cands, {(s[1], s[2], KINDS.index(s[0])) for s in gold}))
    w: Weights = {}
    seen: Weights = {}
    r = random.Random(seed)
    for _ in range(epochs):
        r.shuffle(made)
        for count, cands, gold in made:
            _, chances, touching = _expect(count, cands, w)
            step: Weights = {}
            at = 0
            for _, _, a, b, kinds, f in cands:
                for k in kinds:
                    gap = ((a, b, k) in gold) - chances[at][0]
                    at += 1
                    if abs(gap) > 1e-4:
                        for x in ("", *f):
                            step[x, k] = step.get((x, k), 0.0) + gap
            if touching > 1e-4:
                step["touch", -1] = -touching
            for key, g in step.items():
                g -= 1e-3 * w.get(key, 0.0)
                seen[key] = seen.get(key, 0.0) + g * g
                w[key] = w.get(key, 0.0) + 0.5 * g / math.sqrt(1e-6 + seen[key])
    return tuple(sorted((k, round(v, 6)) for k, v in w.items()))


def field_spans(text: str, w: Weights) -> list[Span]:
    """What the field finds in the whole text."""
    out = []
    for a, b in zones(text):
        bounds = _bounds(text, a, b)
        out += [(KINDS[k], bounds[i], bounds[j]) for i, j, _, k in _decode(len(bounds) - 1, _candidates(text, bounds), w)]
    return out


def all_spans(text: str, w: Weights) -> tuple[list[Span], list[Span]]:
    """The base spans, and these with what the field adds where none of them is."""
    base = base_spans(text)
    taken: list[list[int]] = []  # where base spans are, as stretches apart from each other
    for _, a, b in base:
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    found, at = [], 0
    for s in field_spans(text, w):
        while at < len(taken) and taken[at][1] <= s[1]:
            at += 1
        if at == len(taken) or s[2] <= taken[at][0]:
            found.append(s)
    return base, sorted(base + found, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if found else base


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; spans that overlap become one, named after the first."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _mapped(docs: DataFrame, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    """id and what row(text, weights) gives, by schema, for each row of docs."""
    weights = trained()
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    empty = docs.sparkSession.createDataFrame([], schema).schema
    names = empty.names
    kinds = [pa.int64() if t.dataType.simpleString() == "bigint" else pa.string() for t in empty]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = dict(weights)
        for batch in sliced(batches):
            out = [row(t, w) for t in batch.column(1).to_pylist()]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["_id", *names])

    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, {schema}").withColumnRenamed("_id", id_col)


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added.

    Null and empty texts have no spans. Ids, null ones too, and repeated rows are passed on as they are. Columns other
    than the two named are not read.
    """

    def row(text: str, w: Weights) -> tuple:
        base, spans = all_spans(text, w)
        counts = [sum(s[0] == k for s in base) for k in KINDS]
        return (*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans) - len(base))

    return _mapped(docs, id_col, text_col, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", row)


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span in its text replaced by [EMAIL], [IP], [CARD] or [PHONE]; null texts stay null, all else as it was."""
    weights = trained()

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = dict(weights)
        for batch in sliced(batches):
            texts = [None if t is None else masked(t, all_spans(t, w)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
