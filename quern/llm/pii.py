"""Format-preserving pseudonyms for personal data.

Numbers and dates are found by their layout, validated (check digits, ranges, the calendar) and
replaced by others that are just as valid and look alike. Each kind of value is a range of whole
numbers; a keyed Feistel network permutes it, walking on while the result lies outside. So equal
values get equal pseudonyms in every document and in every layout, different values different
ones, and whoever holds the key can undo it.

Kinds: cards (13 to 19 digits by Luhn that begin with 2 to 6, 15 with 1 and 16 with 7 to 9; the
first digit stays, the check digit follows), IBANs (mod 97), phone numbers (international ones with
+, and ten digits in the North American layout; the country code, by the ITU's list, stays, and so
does a trunk zero in brackets; all other digits are permuted together, however they are set),
social security numbers, IPv4 addresses, dates from 1900 to 2099
(2024-01-31, 31.01.2024, 31/01/2024; 12/31/2024 where the day can't come first), e-mail addresses
(letters and digits before the @; the domain stays) and secrets: 16 to 128 hexadecimal digits with
letters among them, and access keys (AKIA and 16 signs). A date with the month first stays so, and can be undone
only if its pseudonym can't be read with the day first.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import secrets
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._bytes import trimmed
from quern.llm._io import table

#: The session's setting for the key. Without one a session makes itself a random key.
KEY_SETTING = "spark.quern.pii.key"
ROUNDS = 10
FIRST_DAY = dt.date(1900, 1, 1).toordinal()
DAYS = dt.date(2100, 1, 1).toordinal() - FIRST_DAY
LETTERS = "abcdefghijklmnopqrstuvwxyz"

PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<hex>(?<![0-9A-Za-z])(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])(?:[0-9a-f]{16,128}|[0-9A-F]{16,128})(?![0-9A-Za-z]))"
    r"|(?P<access>(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z]))"
    r"|(?P<intl>(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .\-]?\(?[0-9]{1,5}\)?){2,6}(?![0-9]))"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<ssn>(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9]))"
    r"|(?P<iso>(?<![0-9\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9]))"
    r"|(?P<dmy>(?<![0-9./])[0-9]{1,2}(?P<sep>[./])[0-9]{1,2}(?P=sep)[0-9]{4}(?![0-9]|[./][0-9]))"
    r"|(?P<card>(?<![0-9A-Za-z])(?:[0-9]{4}(?P<gap>[ \-])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4}(?:(?P=gap)[0-9]{1,3})?|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z]))"
    r"|(?P<local>(?<![0-9A-Za-z])(?:\([0-9]{3}\) ?|[0-9]{3}[\-. ])[0-9]{3}[\-. ][0-9]{4}(?![0-9A-Za-z]))"
)
#: What every value that PATTERN finds has in it: only an access key may have no digit.
HINT = "[0-9@]|AKIA"
#: Country codes of one digit and of two; all others have three.
ONE, TWO = {"1", "7"}, set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def country_digits(signs: str) -> int:
    """How many digits of an international number are its country code."""
    return 1 if signs[0] in ONE else 2 if signs[:2] in TWO else 3


def feistel(value: int, size: int, key: bytes, kind: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse. kind makes one for each purpose."""
    if not 0 <= value < size:
        raise ValueError("value outside its range")
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8

    def turn(r: int, x: int) -> int:
        h = hashlib.blake2b(bytes([r]) + x.to_bytes(width, "big"), key=key[:64], person=hashlib.blake2b(kind, digest_size=16).digest(), digest_size=min(64, width + 8))
        return int.from_bytes(h.digest(), "big") & mask

    while True:
        left, right = value >> half, value & mask
        if back:
            for r in reversed(range(ROUNDS)):
                left, right = right ^ turn(r, left), left
        else:
            for r in range(ROUNDS):
                left, right = right, left ^ turn(r, right)
        value = left << half | right
        if value < size:
            return value


def permute(symbols: str, classes: list[str], key: bytes, kind: str, back: bool = False) -> str:
    """symbols, each of its class of signs, as one number that Feistel permutes."""
    value, size = 0, 1
    for s, c in zip(symbols, classes):
        value, size = value * len(c) + c.index(s), size * len(c)
    value = feistel(value, size, key, f"{kind} {[*map(len, classes)]}".encode(), back)
    out = []
    for c in reversed(classes):
        value, at = divmod(value, len(c))
        out.append(c[at])
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """0 for a valid number; for one that ends in 0 what the last digit lacks."""
    total = sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (d > "4") for i, d in enumerate(reversed(digits)))
    return -total % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def refill(layout: str, signs: str) -> str:
    """layout with its letters and digits replaced by signs in order."""
    it = iter(signs)
    return "".join(next(it) if c.isalnum() else c for c in layout)


D, NZ = "0123456789", "23456789"


def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value, or with back the value of a pseudonym; None if text isn't valid."""
    if kind == "email":
        local, _, domain = text.rpartition("@")
        chars = [c for c in local if c.isalnum()]
        if not chars:
            return None
        classes = [D if c.isdigit() else LETTERS if c.islower() else LETTERS.upper() for c in chars]
        return refill(local, permute("".join(chars), classes, key, "email", back)) + "@" + domain
    if kind == "hex":
        low = text.lower()
        new = permute(low, ["0123456789abcdef"] * len(low), key, "hex", back)
        return new.upper() if text.isupper() else new
    if kind == "access":
        return text[:4] + permute(text[4:], [D if c.isdigit() else LETTERS.upper() for c in text[4:]], key, "access", back)
    if kind == "ip":
        octets = text.split(".")
        if any(int(x) > 255 or len(x) > 1 and x[0] == "0" for x in octets):
            return None
        n = feistel(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, key, b"ip", back)
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind in ("iso", "dmy"):
        parts = re.split(r"[-./]", text)
        order = [(0, 1, 2)] if kind == "iso" else [(2, 1, 0), (2, 0, 1)]
        for y, m, d in order:
            try:
                day = dt.date(int(parts[y]), int(parts[m]), int(parts[d])).toordinal() - FIRST_DAY
            except ValueError:
                continue
            if not 0 <= day < DAYS:
                return None
            new = dt.date.fromordinal(feistel(day, DAYS, key, b"date", back) + FIRST_DAY)
            out = [""] * 3
            out[y], out[m], out[d] = f"{new.year:04}", f"{new.month:0{len(parts[m])}}", f"{new.day:0{len(parts[d])}}"
            sep = re.search(r"[-./]", text)[0]
            return sep.join(out)
        return None
    signs = "".join(c for c in text if c.isalnum())
    if kind == "iban":
        if not 15 <= len(signs) <= 34 or mod97(signs) != 1:
            return None
        body = permute(signs[4:], [D if c.isdigit() else LETTERS.upper() for c in signs[4:]], key, "iban", back)
        return refill(text, f"{signs[:2]}{98 - mod97(signs[:2] + '00' + body):02}{body}")
    if kind == "card":
        if signs[0] not in {15: "123456", 16: "23456789"}.get(len(signs), "23456") or luhn(signs):
            return None
        body = signs[0] + permute(signs[1:-1], [D] * (len(signs) - 2), key, "card", back)
        return refill(text, body + str(luhn(body + "0")))
    if kind == "ssn":
        area, group, serial = int(signs[:3]), int(signs[3:5]), int(signs[5:])
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        n = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        n, serial = divmod(feistel(n, 898 * 99 * 9999, key, b"ssn", back), 9999)
        area, group = divmod(n, 99)
        area += 1 + (area >= 665)
        return f"{area:03}-{group + 1:02}-{serial + 1:04}"
    trunk = "(0)" in text and kind == "intl"
    if trunk:  # not dialled from abroad, and no part of the number
        text = text.replace("(0)", "(\0)", 1)
        signs = "".join(c for c in text if c.isalnum())
    code = country_digits(signs) if kind == "intl" else 0
    national = signs[code:]
    if not 8 <= len(signs) <= 15 and kind == "intl" or kind == "local" and (national[0] not in NZ or national[3] not in NZ) or len(national) < 6:
        return None
    classes = [D] * len(national)
    if len(national) == 10 and (not code or signs[:code] == "1") and national[0] in NZ and national[3] in NZ:
        classes[0] = classes[3] = NZ
    new = refill(text, signs[:code] + permute(national, classes, key, "phone", back))
    return new.replace("(\0)", "(0)") if trunk else new


NAMES = {"intl": "phone", "local": "phone", "iso": "date", "dmy": "date", "hex": "token", "access": "token"}


def replace(text: str, key: bytes, known: dict[tuple[str, str], str | None]) -> tuple[str, list[dict]]:
    """The text with its values replaced, and what and where they were in the original."""
    out, last, found, at = [], 0, [], 0
    while m := PATTERN.search(text, at):
        kind, value = m.lastgroup, m[0]
        if kind in ("sep", "gap"):
            kind = "dmy" if kind == "sep" else "card"
        if kind == "hex" and re.match("[A-F]{2}[0-9]{2}", value) and len(value) <= 34 and mod97(value) == 1:
            kind = "iban"
        if (kind, value) not in known:
            known[kind, value] = pseudonym(kind, value, key)
        if (new := known[kind, value]) is None:
            # What isn't valid as one kind may hold another that starts later.
            at = m.start() + 1
            while at < m.end() and text[at].isalnum() and text[at - 1].isalnum():
                at += 1
            continue
        out += [text[last : m.start()], new]
        found.append({"kind": NAMES.get(kind, kind), "start": m.start(), "end": m.end()})
        last = at = m.end()
    return "".join([*out, text[last:]]), found


FOUND_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _replacer(key: bytes, names: list[str], count: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict = {}
            col = b.column(names.index("text"))
            hot = [i for i, x in enumerate(pc.match_substring_regex(col, HINT).to_pylist()) if x]
            texts, found = {}, {}
            for i in hot:
                new, f = replace(col[i].as_py(), key, known)
                if f:
                    texts[i], found[i] = new, f
            cols = dict(zip(names, b.columns))
            if texts:
                mask = pa.array([i in texts for i in range(len(col))])
                cols["text"] = pc.replace_with_mask(col, mask, pa.array([texts[i] for i in sorted(texts)], col.type))
                if "n_chars" in cols and pa.types.is_integer(cols["n_chars"].type):
                    n = pc.utf8_length(cols["text"])
                    cols["n_chars"] = pc.if_else(mask, n.cast(cols["n_chars"].type), cols["n_chars"])
            if count:
                cols["found"] = pa.array([found.get(i, []) for i in range(len(col))], FOUND)
            yield pa.RecordBatch.from_arrays([*cols.values()], names=[*cols])

    return trimmed(run)


def _key(spark: SparkSession, key: str | None) -> bytes:
    """The given key, else the session's, else a random one that the session keeps: without a key
    of one's own, values are linked within the session and nobody can undo them."""
    if not (found := key or spark.conf.get(KEY_SETTING, None)):
        found = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, found)
    return found.encode()


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with the values in text replaced, and n_chars, if there is one, as the new text's length.

    Row by row and without a shuffle: repeated rows, null ids, null and empty texts and other
    columns pass as they are; so does what isn't valid. An empty table stays empty. Ids may have
    any type. key: see _key.
    """
    return docs.mapInArrow(_replacer(_key(docs.sparkSession, key), docs.columns, False), docs.schema)


def find(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, text, found) a row of docs: the text with pseudonyms, and (kind, start, end) of each
    value in the original text. Otherwise as pseudonymise."""
    slim = docs.select("doc_id", "text")
    more = T.StructType([*slim.schema.fields, T.StructField("found", FOUND_TYPE)])
    return slim.mapInArrow(_replacer(_key(docs.sparkSession, key), slim.columns, True), more)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents")).withColumn("n_found", F.size("found"))
