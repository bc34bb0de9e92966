"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over a text finds anchors: at-signs, plus signs, URL schemes, digits and the cue
words of accounts and credentials. At each anchor a deterministic local parser looks left and right for the boundaries of
an email address, an IP address, a card, a phone number, a URL, an account number or a credential, and validates what it
found (address parts up to 255, card checksum, digit counts, IBAN checksum, a credential's length and make). The base
kinds are leftmost; spans of one kind don't overlap.

A null or empty text has no spans. Ids may repeat or be null: there is one output row for each input row, and none for an
empty table. Spans that begin together are listed by kind. A very long text is parsed as a whole, in one pass: no parser
goes back behind its kind's last match. Spans are [start, end) in code points.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import check_columns, map_arrow

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "secret", "url")
#: What redaction replaces; URLs by themselves are no personal data.
PERSONAL = (*BASE, "account", "secret")
# Words before an account or identity number, and words (or ends of names) before a credential.
ACCOUNTS = ("iban", "bic", "account", "acct", "konto", "kontonummer", "compte", "cuenta", "conto", "ssn", "nif", "dni", "passport", "reisepass", "passeport", "pasaporte")
SECRETS = ("token", "secret", "password", "passwd", "passphrase", "passwort", "contraseña", "pwd", "api_key", "api-key", "apikey", "access_key", "accesskey", "secret_key", "private_key", "auth_key", "credential", "credentials", "bearer", "authorization")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
REST = re.compile(r"[^\s<>\"'`{}|\\^\x00-\x20]+")
LEAD = re.compile(r"(?:[ \t]*(?:no\.?|nr\.?|number|[:#=]))*[ \t]*")
GROUP = re.compile(r"[A-Za-z0-9]+")
COUNTRY = re.compile(r"[A-Z]{2}[0-9]{2}", re.IGNORECASE)
#: Code points of an IBAN, at least and at most, by its standard; code points of a credential at least.
IBAN_LENGTHS, SECRET_LENGTH = (15, 34), 8
#: From a cue to its value: the end of a quoted name, a sign of assignment (or none after "bearer"), a scheme's name.
GIVEN = re.compile(r"[\"']?[ \t]*(?::=|=>|[:=])[ \t]*(?:(?:bearer|basic|token)[ \t]+)?", re.IGNORECASE)
QUOTED = {q: re.compile(rf"[^{q}\n]*") for q in "\"'`"}
BARE = re.compile(r"[^\s\"'`,;<>()\[\]{}]+")


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for what, cues in (("account", ACCOUNTS), ("secret", SECRETS)):
        for cue in cues:
            for form in {cue, cue.title(), cue.capitalize(), cue.upper()}:
                found.add_word(form, (what, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "").replace("-", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", s, re.ASCII):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban_end(text: str, at: int) -> int | None:
    """The end of the longest IBAN that begins at `at`; its groups may be parted by single spaces or hyphens."""
    if not COUNTRY.match(text, at):
        return None
    length, end = 0, None
    while m := GROUP.match(text, at):
        length += len(m[0])
        if length > IBAN_LENGTHS[1]:
            break
        if length == len(m[0]):
            begin = at
        at = m.end()
        if length >= IBAN_LENGTHS[0] and iban(text[begin:at]):
            end = at
        if text[at : at + 1] not in (" ", "-"):
            break
        at += 1
    return end


def account_end(text: str, start: int) -> tuple[int, int] | None:
    """The number after a cue that ends at start: an IBAN, or groups that each have a digit, with six digits at least."""
    at = LEAD.match(text, start).end()
    if end := iban_end(text, at):
        return at, end
    end, digits, next_ = at, 0, at
    while (m := GROUP.match(text, next_)) and (has := sum(c in DIGITS for c in m[0])):
        end, digits = m.end(), digits + has
        if text[end : end + 1] not in (" ", "-"):
            break
        next_ = end + 1
    return (at, end) if digits >= 6 and end - at > 6 else None


def secret_end(text: str, start: int, bearer: bool) -> tuple[int, int] | None:
    """The credential after a cue that ends at start: what stands in quotes or up to white space behind an assignment. It
    has SECRET_LENGTH code points at least, and unless it is quoted, letters and digits both."""
    if m := GIVEN.match(text, start):
        at = m.end()
    elif bearer and text[start : start + 1] in (" ", "\t"):
        at = start + 1
    else:
        return None
    if (q := text[at : at + 1]) in QUOTED:
        m = QUOTED[q].match(text, at + 1)
        if len(m[0]) >= SECRET_LENGTH and text[m.end() : m.end() + 1] == q and not any(map(str.isspace, m[0])):
            return at + 1, m.end()
        return None
    m = BARE.match(text, at)
    if m and len(value := m[0].rstrip(".!?:")) >= SECRET_LENGTH and any(map(str.isdigit, value)) and any(map(str.isalpha, value)):
        return at, at + len(value)
    return None


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kind as listed in KINDS."""
    found = []
    after = dict.fromkeys(KINDS, 0)  # each kind goes on behind its last match, valid or not
    for last, (what, n) in anchors().iter(text):
        at = last - n + 1
        if what == "digit":
            if at >= after["ip"]:
                if m := ADDRESS.match(text, at):
                    after["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                        found.append((at, m.end(), "ip"))
                else:  # the rest of this run of digits can't begin one either
                    after["ip"] = run_end(text, at)
            if at >= after["card"] and (m := CHAIN.match(text, at)):
                after["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((at, m.end(), "card"))
        elif what == "plus":
            if at >= after["phone"] and (m := DIALLED.match(text, at)):
                after["phone"] = m.end()
                if 10 <= sum(c in DIGITS for c in m[0]) <= 15:
                    found.append((at, m.end(), "phone"))
        elif what == "at":
            start = at
            while start > after["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                after["email"] = m.end()
                found.append((start, m.end(), "email"))
        elif what == "scheme":
            start = at
            while start > after["url"] and text[start - 1] in SCHEME:
                start -= 1
            while start < at and not (text[start].isascii() and text[start].isalpha()):
                start += 1
            if start < at and (m := REST.match(text, at + 3)) and (end := at + 3 + len(m[0].rstrip(".,;:!?)]"))) > at + 3:
                after["url"] = end
                found.append((start, end, "url"))
        elif what == "secret":  # may end a longer name, such as access_token, but not begin one
            if at >= after["secret"] and (value := secret_end(text, last + 1, text[at].lower() == "b")):
                after["secret"] = value[1]
                found.append((*value, "secret"))
        elif at >= after["account"] and not (at and text[at - 1].isalnum()) and (number := account_end(text, last + 1)):
            after["account"] = number[1]
            found.append((*number, "account"))
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


RUN = re.compile("[0-9]+")


def run_end(text: str, at: int) -> int:
    return RUN.match(text, at).end()


def listed(found) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def redacted(text: str, found) -> str:
    """The text with each personal span replaced by its kind; of overlapping spans the first stands for all."""
    out, end = [], 0
    for start, stop, kind in found:
        if kind in PERSONAL:
            if start >= end:
                out += [text[end:start], f"<{kind}>"]
            end = max(end, stop)
    return "".join([*out, text[end:]])


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, n_account, n_secret,
    n_url, base_sha256, spans.

    A narrow map without a shuffle; memory is bounded by a slice of texts.
    """
    check_columns(docs, doc_id, text)

    def make():
        def each(columns):
            rows = [spans(t or "") for t in columns[1]]
            base = [[s for s in r if s[2] in BASE] for r in rows]
            counts = [pa.array([sum(s[2] == kind for s in r) for r in rows], pa.int64()) for kind in KINDS]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *counts, pa.array([hashlib.sha256(listed(r).encode()).hexdigest() for r in base], pa.string()), pa.array(map(listed, rows), pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

        return each

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(rows, make, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def without_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the personal spans of the texts replaced by <kind>. Other columns and null texts stay as they are."""
    check_columns(docs, text)
    at, schema = docs.columns.index(text), docs.schema

    def run(batches):
        for batch in batches:
            texts = [t if t is None else redacted(t, spans(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.column(at).type))

    return docs.mapInArrow(run, schema)
