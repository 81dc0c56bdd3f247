"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their scores.

Four base kinds (``email ip card phone``) follow fixed patterns and stand by themselves. Three more
kinds are proposed by patterns and kept when their score, moved by the words around them, reaches
``threshold``: ``iban`` (confirmed by the mod-97 check), ``ssn`` and ``tel`` (numbers without a country
code, which only words such as "call" make likely). Scores of base spans move too but never drop them.

Defined cases: a null text counts as empty and has no spans; a text is searched whole, in time linear
in its length; offsets are code points, ends exclusive; equal rows give equal results; a null key is
carried along; input columns other than key and text play no part, so their names cannot clash.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosecast.llm.common import add_columns, field

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn", "tel")
KINDS = BASE + EXTRA
THRESHOLD = 0.6
WINDOW = 40  # code points before and after a span that are searched for context words

# How likely a confirmed proposal is without context, and the words that speak for it.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.8, "ssn": 0.4, "tel": 0.4}
CONTEXT = {
    "email": ("email", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "tel": ("phone", "call", "tel", "mobile", "fax"),
}
AGAINST = ("example", "version", "order", "invoice", "isbn", "serial")
BOOST, PENALTY = 0.3, 0.2

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # matches wherever it starts, so it never goes back
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_IBAN_ENDS = re.compile(r"[A-Z0-9](?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORDS = re.compile(r"[a-z]+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of international account numbers: country and check digits go last, letters count from ten."""
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """The longest end after a whole token at which a proposal passes the check; the search goes on after it.

    A proposal that fails at every end may hide one that starts at its next token.
    """
    found, m = [], _IBAN.search(text)
    while m:
        a = m.start()
        ends = [e.end() for e in _IBAN_ENDS.finditer(text, a, m.end())]
        own = (b for b in reversed(ends) if len(text[a:b].replace(" ", "")) >= 15 and mod97(text[a:b]))
        b = next(own, None)
        if b is not None:
            found.append((a, b))
        m = _IBAN.search(text, ends[0] if b is None else b)
    return found


def emails(text: str) -> list[tuple[int, int]]:
    """Found from each ``@`` outwards: a run before it cannot be searched again and again."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", free)
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    """Every four parts of a dotted chain of numbers, from its left."""
    found = []
    for chain in _DOTTED.finditer(text):
        parts, start = chain.group().split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in four):
                found.append((start, end))
            start = end + 1
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind as listed, then start."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [("ip", a, b) for a, b in addresses(text)]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group()) if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    """The prior of a kind, moved by the words within ``WINDOW`` code points."""
    words = set(_WORDS.findall((text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]).lower()))
    moved = PRIOR[kind] + BOOST * any(w in words for w in CONTEXT[kind]) - PENALTY * any(w in words for w in AGAINST)
    return min(1.0, max(0.0, moved))


def find_spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score): base ones always, others with enough score and no overlap."""
    text = text or ""
    base = base_spans(text)
    extra = []
    if _DIGIT.search(text):
        taken = bytearray(len(text))  # marks code points, so a span is tried in time of its own length
        for _, a, b in base:
            taken[a:b] = b"\x01" * (b - a)
        proposed = (ibans(text), *([m.span() for m in p.finditer(text)] for p in (_SSN, _TEL)))
        for kind, spans in zip(EXTRA, proposed):
            for a, b in spans:
                # a number may be proposed twice: the kind listed first keeps it
                if 1 in taken[a:b] or score(text, kind, a, b) < threshold:
                    continue
                taken[a:b] = b"\x01" * (b - a)
                extra.append((kind, a, b))
    return [(k, a, b, score(text, k, a, b)) for k, a, b in base + extra]


def redact(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b, _ in sorted(find_spans(text, threshold), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def pii_spans(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, spans): the spans of every text with their scores; see the module for the defined cases."""
    fields = [field("spans", "array<struct<kind:string,start:int,end:int,score:double>>")]

    def make():
        def work(texts):
            names = ("kind", "start", "end", "score")
            return [[[dict(zip(names, s)) for s in find_spans(t, threshold)] for t in texts]]

        return work

    return add_columns(df, text, make, fields, [key])


def redact_column(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with the spans of one text column replaced; null stays null, all other columns stay as they are."""
    columns = df.columns
    out = add_columns(df, text, lambda: lambda texts: [[redact(t, threshold) for t in texts]], [field(text, "string")], columns)
    return out.select(*[F.col(f"`{c}`") for c in columns])


def pii_digest(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per text: counts of the base kinds, a digest of the base spans, and all spans as text."""
    spans = pii_spans(df, key, text, threshold)
    written = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    base_written = F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        key,
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(F.array_join(base_written, ","), 256).alias("base_sha256"),
        F.array_join(written, ",").alias("spans"),
        *[count(kind).alias(f"n_{kind}") for kind in EXTRA],
    )
