"""Personal data: regular expressions propose spans, checks confirm them, and words nearby move
the score.

Base kinds are fixed: email, ip (parts at most 255), card (14 to 19 digits passing Luhn) and
phone (a plus sign, 10 to 15 digits); every confirmed match is kept whatever its score. Added
kinds: iban (country, length and mod-97; in a country without a known length mod-97 and a word
about accounts nearby), card_group (an unbroken group of 14 to 19 digits passing
Luhn, where the longer match of card around it failed), card13 (13 digits passing Luhn, with a
word about cards nearby), ssn (three groups of digits in the assigned ranges, with such a word nearby) and
local_phone (a number without a plus sign, with a word about telephones nearby). An added span
needs a score of `threshold`: checks that can hardly pass by chance give it alone, the others
need the context. Added spans that overlap a base span or an earlier added one are dropped.

The four digit patterns can only match inside runs of digits, spaces and . ( ) - +, and an email
only around an @, so a text is scanned once for such runs and the patterns run inside them. No
character is looked at more than a few times, whatever the text: an email is its domain, looked
for after each @, and then its local part, looked for backwards; an address in digits can only
begin where a run of digits does; and quantifiers do not give back what they took.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, session_ready

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "card_group", "card13", "ssn", "local_phone")

_LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]*+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_RUN = re.compile(r"[0-9+][0-9 ().+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_GROUP = re.compile(r"(?<![0-9])[0-9]{14,19}(?![0-9])")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL = re.compile(r"(?<![0-9+])\(?0?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IBAN_HINT = re.compile(r"[A-Z]{2}[0-9]{2}[ A-Z0-9]")
_DIGITS = re.compile(r"[^0-9]")

# Lengths of bank account numbers by country, the whole registry.
IBAN_LENGTHS = {
    k: n
    for n, names in {
        15: "NO",
        16: "BE",
        18: "DK FI FK FO GL NL SD",
        19: "MK SI",
        20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST",
        26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA",
        30: "JO KW MU YE",
        31: "MT SC",
        32: "LC",
        33: "RU",
    }.items()
    for k in names.split()
}

# Words that raise the score of a kind, in the text before or after it.
CONTEXT = {
    "card13": ["card", "visa", "credit", "debit", "karte", "kreditkarte", "carte", "tarjeta"],
    "ssn": ["ssn", "social security", "social-security", "taxpayer"],
    "local_phone": ["phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"],
    "card_group": ["card", "visa", "credit", "debit", "karte", "carte", "tarjeta"],
    "iban": ["iban", "account", "bank", "konto", "compte", "cuenta"],
    "email": ["email", "e-mail", "mail", "contact"],
    "ip": ["ip", "address", "server", "host"],
    "card": ["card", "visa", "credit", "debit", "karte", "carte", "tarjeta"],
    "phone": ["phone", "tel", "call", "mobile", "fax", "telefon"],
}
_CONTEXT = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, w)) + r")(?!\w)", re.I) for k, w in CONTEXT.items()}

#: The score of a confirmed match, before its context.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "card_group": 0.7, "card13": 0.4, "ssn": 0.3, "local_phone": 0.3}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of bank account numbers: letters as 10 to 35, the first four characters last."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            low, step = at, 64
            while low > done:  # blocks of growing size before the @, read backwards
                block = text[max(done, low - step) : low][::-1]
                low -= (size := _LOCAL_PART.match(block).end())
                if size < len(block):
                    break
                step *= 2
            if low < at:
                yield "email", low, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def _base(text: str) -> list[tuple[str, int, int]]:
    out = list(_emails(text))
    for run in _RUN.finditer(text):
        low, high = run.span()
        if high - low < 7:
            continue
        for m in _IP.finditer(text, low, high):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text, low, high):
            if m.end() - m.start() >= 14 and 14 <= len(d := _DIGITS.sub("", m.group())) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in run.group():
            for m in _PHONE.finditer(text, low, high):
                if 10 <= len(_DIGITS.sub("", m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return out


def _account_end(text: str, start: int, high: int) -> int:
    """Where the bank account number ends that begins at start, at most at high, or 0. Capital
    words may follow it. In a country that the registry does not name any length from 15 to 34
    will do, if a word about accounts is nearby."""
    size = IBAN_LENGTHS.get(text[start : start + 2])
    ends = [k + 1 for k in range(start, high) if text[k] != " "]
    for n in (size,) if size else range(min(34, len(ends)), 14, -1):
        if n <= len(ends) and not text[ends[n - 1] : ends[n - 1] + 1].isalnum() and mod97(text[start : ends[n - 1]].replace(" ", "")):
            if size or score(text, "iban", start, ends[n - 1]) > PRIOR["iban"]:
                return ends[n - 1]
    return 0


def _added(text: str):
    if _IBAN_HINT.search(text):
        m = _IBAN.search(text)
        while m:
            end = _account_end(text, *m.span())
            if end:
                yield "iban", m.start(), end
            m = _IBAN.search(text, end or m.start() + 1)
    for run in _RUN.finditer(text):
        low, high = run.span()
        if high - low < 9:
            continue
        for m in _CARD.finditer(text, low, high):
            d = _DIGITS.sub("", m.group())
            if len(d) == 13 and luhn(d):
                yield "card13", *m.span()
            elif len(d) > 14 and not (len(d) <= 19 and luhn(d)):
                for group in _GROUP.finditer(text, *m.span()):
                    if group.end() - group.start() < len(m.group()) and luhn(group.group()):
                        yield "card_group", *group.span()
        for m in _SSN.finditer(text, low, high):
            area, group, serial = m.groups()
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                yield "ssn", *m.span()
        for m in _LOCAL.finditer(text, max(0, low - 1), high):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 12:
                yield "local_phone", *m.span()


def score(text: str, kind: str, start: int, end: int, reach: int = 40) -> float:
    near = text[max(0, start - reach) : start] + " \n " + text[end : end + reach // 2]
    return min(1.0, PRIOR[kind] + (0.4 if _CONTEXT[kind].search(near) else 0.0))


def find(text: str | None, threshold: float = 0.7) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind in the order of KINDS; code points, end
    exclusive."""
    text = text or ""
    base = _base(text)
    begin, end = [], []  # disjoint spans in order, those that are taken
    for _, s, e in sorted(base, key=lambda x: x[1:]):
        if end and s < end[-1]:
            end[-1] = max(end[-1], e)
        else:
            begin.append(s)
            end.append(e)
    spans = [(k, s, e, score(text, k, s, e)) for k, s, e in base]
    for k, s, e in sorted(_added(text), key=lambda x: (x[1], KINDS.index(x[0]))):
        at = bisect_right(end, s)
        if (at == len(end) or begin[at] >= e) and (x := score(text, k, s, e)) >= threshold:
            spans.append((k, s, e, x))
            begin.insert(at, s)
            end.insert(at, e)
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def redact(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """The text with each span, or each run of overlapping spans, replaced by its kind."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for k, s, e, _ in spans:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, with_text: bool = False) -> DataFrame:
    """One row per input row: id, pii (an array of kind, start, end, score) and, if with_text,
    redacted (the text with placeholders; null stays null).

    A null or empty text has no spans. Repeated rows and null ids each give their row. Other
    columns are ignored.
    """
    session_ready(docs.sparkSession)

    def run(batches):
        for block in blocks(batches, "_text"):
            texts = block.column("_text").to_pylist()
            found = [find(t, threshold) for t in texts]
            spans = pa.array([[dict(zip(("kind", "start", "end", "score"), x)) for x in f] for f in found], SPAN)
            columns = [block.column("_id"), spans]
            if with_text:
                columns.append(pa.array([redact(t, f) for t, f in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "pii", "redacted"][: len(columns)])

    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    schema = "id long, pii array<struct<kind:string,start:bigint,end:bigint,score:double>>" + (", redacted string" if with_text else "")
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The input rows with personal data in text_col replaced by placeholders; all columns stay,
    n_chars (where there is one) follows the new text. Null texts stay null."""
    session_ready(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches):
        for block in blocks(batches, text_col):
            new = pa.array([redact(t, find(t, threshold)) for t in block.column(text_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == place else block.column(k) for k in range(block.num_columns)], names=block.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
