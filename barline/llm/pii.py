"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, digits, schemes and cue words. From each anchor
a local parser walks outwards over the characters its kind allows, so that only the surroundings of
anchors are ever parsed, and checks what it has found. Every parser takes time linear in its stretch.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import col

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "account")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Where an anchor stands in a run of these characters, the run holds all matches around it.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9.]*")
SPACED = re.compile(r"[0-9\x20-]*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+)*")
URL = re.compile(r"[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s<>\"]*)?")
VALUE = re.compile(r"[\s:#=.]{1,4}(?:is\s|no\.?\s|number\s)?\s*([A-Za-z]{0,4}[0-9][A-Za-z0-9-]{4,33})")

# Schemes and the cue words that announce an account or identity number.
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")
CUES = ("account", "acct", "iban", "ssn", "passport", "konto", "cuenta", "compte", "routing", "tax id",
        "customer id", "user id")


@functools.cache
def automaton():
    import ahocorasick
    a = ahocorasick.Automaton()
    for digit in "0123456789":
        a.add_word(digit, ("digit", 1))
    a.add_word("@", ("at", 1))
    for word in SCHEMES:
        a.add_word(word, ("scheme", len(word)))
    for cue in CUES:
        for spelling in {cue, cue.capitalize(), cue.upper()}:
            a.add_word(spelling, ("cue", len(spelling)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign; its local part starts at ``floor`` at the earliest."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    m = DOMAIN.match(text, at + 1) if start < at else None
    return (start, m.end()) if m else None


def ips_in(run: str, base: int):
    """Four numbers joined by single dots, from the left; a larger group starts over after them."""
    for m in QUAD.finditer(run):
        parts, at = m.group().split("."), base + m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            n = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + n
            at += n + 1


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (code points, end exclusive) of every kind, in order of their start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE + ADDED}
    ends = dict.fromkeys(("email", "dotted", "spaced", "phone", "url", "account"), 0)
    for last, (kind, width) in automaton().iter(text):
        at = last - width + 1
        if kind == "at":
            if at >= ends["email"] and (span := email_at(text, at, ends["email"])):
                out["email"].append(span)
                ends["email"] = span[1]
        elif kind == "digit":
            # The first digit of a run is the anchor for all matches in it.
            if at >= ends["dotted"]:
                ends["dotted"] = DOTTED.match(text, at).end()
                out["ip"].extend(ips_in(text[at:ends["dotted"]], at))
            if at >= ends["spaced"]:
                ends["spaced"] = SPACED.match(text, at).end()
                for m in CARD.finditer(text, at, ends["spaced"]):
                    number = digits_of(m.group())
                    if 13 <= len(number) <= 19 and luhn(number):
                        out["card"].append(m.span())
            if at > ends["phone"] and text[at - 1] == "+":
                if m := PHONE.match(text, at - 1):
                    ends["phone"] = m.end()
                    if 9 <= len(digits_of(m.group())) <= 15:
                        out["phone"].append(m.span())
        elif kind == "scheme":
            if at >= ends["url"] and (m := URL.match(text, last + 1)):
                ends["url"] = m.start() + len(m.group().rstrip(".,;:!?)'"))
                out["url"].append((at, ends["url"]))
        elif at >= ends["account"] and not (at and text[at - 1].isalnum()):
            if m := VALUE.match(text, last + 1):
                if sum(map(str.isdigit, m.group(1))) >= 5:
                    out["account"].append(m.span(1))
                    ends["account"] = m.end()
    return out


def joined(spans: dict[str, list[tuple[int, int]]], kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in sorted(spans[k]))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are kind:start:end in code points, ordered by kind, then start, joined by commas;
    ``base_sha256`` covers the four base kinds, ``spans`` also addresses of pages (url) and account
    numbers after a cue word (account). Null counts as empty text, which has no spans and the hash
    of the empty string. Rows repeating a key are read one by one; an empty table gives no rows;
    other columns, of any name, are ignored.
    """
    df = docs.select(col(key).alias("id"), F.coalesce(col(text), F.lit("")).alias("body"))
    kind = df.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [find(t) for t in b.column("body").to_pylist()]
            base = [joined(f, BASE) for f in found]
            yield pa.RecordBatch.from_pydict({
                "id": b.column("id"), **{f"n_{k}": pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE},
                "base_sha256": pa.array([hashlib.sha256(s.encode()).hexdigest() for s in base], pa.string()),
                "spans": pa.array([joined(f, BASE + ADDED) for f in found], pa.string())})

    return df.mapInArrow(run, f"id {kind}, " + ", ".join(f"n_{k} long" for k in BASE)
                         + ", base_sha256 string, spans string").withColumnRenamed("id", key)


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with every span replaced by its kind in angle brackets; null stays null.
    Where spans overlap, the earlier one, then the longer one, is replaced."""
    df = docs.select(col(key).alias("id"), col(text).alias("body"))
    kind = df.schema["id"].dataType.simpleString()

    def mask(t):
        if t is None:
            return None
        spans, out, at = find(t), [], 0
        for a, b, k in sorted(((a, b, k) for k, s in spans.items() for a, b in s), key=lambda x: (x[0], -x[1])):
            if a >= at:
                out += [t[at:a], f"<{k}>"]
                at = b
        return "".join(out) + t[at:]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "body": pa.array(
                map(mask, b.column("body").to_pylist()), pa.string())})

    return df.mapInArrow(run, f"id {kind}, body string").toDF(key, text)
