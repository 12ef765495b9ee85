"""Personal data by anchor expansion.

One Aho-Corasick pass over the text finds anchors: at-signs, URL schemes, plus
signs, digits and identifier cues. Around each anchor a deterministic parser
expands to the boundaries of the candidate and validates it. Emails, IPv4
addresses, payment cards and phone numbers are the base kinds; accounts
(IBANs that pass mod 97, social security numbers behind a cue), URL
credentials and secrets behind a cue are added. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemill.llm.frames import add_columns

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "credential", "secret")
# Words that announce an identifier (fixed values).
CUES = {"iban": "account", "IBAN": "account", "Iban": "account", "ssn": "social", "SSN": "social", "social security": "social", "Social Security": "social", "token": "secret", "api_key": "secret", "apikey": "secret", "password": "secret", "secret": "secret"}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_quads = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_run = re.compile(r"[0-9]+")
_chain = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_iban = re.compile(r"[^0-9A-Za-z]{0,8}([A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]){11,30})(?![0-9A-Za-z])")
_social = re.compile(r"[^0-9A-Za-z]{0,8}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_secret = re.compile(r"[\x20\t]{0,2}[=:][\x20\t]{0,2}[\"']?([A-Za-z0-9_+/-]{16,})")
_login = re.compile(r"://([^\s/@:?#]+:[^\s/@?#]+)@")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for mark in ("@", "+", "://", *"0123456789"):
        a.add_word(mark, ("0" if mark.isdigit() else mark, len(mark)))
    for cue, what in CUES.items():
        a.add_word(cue, (what, len(cue)))
    a.make_automaton()
    return a


class Scanner:
    def __init__(self):
        self.anchors = _automaton()

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """All spans, by kind in the order of KINDS and then by start."""
        if not text:
            return []
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        done = dict.fromkeys(KINDS, 0)  # no later match of the kind starts before it
        for last, (what, size) in self.anchors.iter(text):
            at = last + 1 - size
            if what == "0":
                if at >= done["ip"]:
                    self._ip(text, at, found["ip"], done)
                if at >= done["card"]:
                    self._card(text, at, found["card"], done)
            elif what == "@":
                self._email(text, at, found["email"], done)
            elif what == "+":
                self._phone(text, at, found["phone"], done)
            elif what == "://":
                if m := _login.match(text, at):
                    found["credential"].append(m.span(1))
            elif what == "secret":
                if at >= done["secret"] and (m := _secret.match(text, last + 1)) and any(c.isdigit() for c in m[1]):
                    found["secret"].append(m.span(1))
                    done["secret"] = m.end(1)
            elif at >= done["account"] and (m := (_iban if what == "account" else _social).match(text, last + 1)):
                start, end = m.span(1)
                if what == "social" or mod97(m[1]):
                    found["account"].append((start, end))
                    done["account"] = end
        return [(k, a, b) for k in KINDS for a, b in found[k]]

    @staticmethod
    def _email(text: str, at: int, out: list, done: dict) -> None:
        start = at
        while start > done["email"] and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := _domain.match(text, at)):
            out.append((start, m.end()))
            done["email"] = m.end()

    @staticmethod
    def _ip(text: str, at: int, out: list, done: dict) -> None:
        m = _quads.match(text, at)
        if m is None:  # nor can a later digit of this run begin one
            done["ip"] = _run.match(text, at).end()
            return
        done["ip"] = m.end()
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append(m.span())

    @staticmethod
    def _card(text: str, at: int, out: list, done: dict) -> None:
        m = _chain.match(text, at)
        if m is None:
            done["card"] = at + 1
            return
        done["card"] = m.end()
        if m.end() - at <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())

    @staticmethod
    def _phone(text: str, at: int, out: list, done: dict) -> None:
        if m := _phone.match(text, at):
            done["phone"] = m.end()
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(m.span())


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first one names it."""
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, the number of spans of each base kind, ``base_spans`` and ``spans`` (kind:start:end, comma-joined).

    Null and empty texts have no spans. Repeated rows give repeated rows.
    """

    def make():
        scan = Scanner()

        def run(texts):
            every = [scan.spans(t) for t in texts]
            for kind in BASE_KINDS:
                yield pa.array([sum(s[0] == kind for s in x) for x in every], pa.int64())
            yield pa.array([_listed([s for s in x if s[0] in BASE_KINDS]) for x in every], pa.string())
            yield pa.array([_listed(x) for x in every], pa.string())

        return run

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS]
    fields += [T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType())]
    return add_columns(df, text, fields, make, list(keep))


def mask(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns with every span of ``text`` replaced by its kind; a null text stays null."""

    def make():
        scan = Scanner()
        return lambda texts: (pa.array([redact(t, scan.spans(t)) for t in texts], pa.string()),)

    return add_columns(df, text, [T.StructField(text, T.StringType())], make, list(keep))

